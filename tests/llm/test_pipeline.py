import random
import re

import duckdb

import corpus_pipeline
from skyweave.llm import common, mixing, queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    parts = {"en": ["th", "ing", "er", "wh", "tion"], "de": ["sch", "zu", "ung", "ei", "ver"]}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(80))
    item = text("en")
    rows = [(i, text(x), x, f"s{i % 3}", 1) for i in range(60) for x in [rng.choice(["en", "de"])]]
    rows += [(100, rows[0][1], rows[0][2], "s0", 1), (101, rows[1][1] + " end", rows[1][2], "s1", 1), (102, f"see {item} there", "en", "s2", 1), (103, "123 456 !!", None, "s0", 1), (104, None, None, None, 1)]
    rows += [(105, text("de") + " token = 0123456789abcdef0123456789abcdef", "de", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        current = common.cut(stage(spark, current, str(tmp_path)))
        kept.append({r["doc_id"]: r for r in current.collect()})
        if stage is not corpus_pipeline.mixed:
            assert current.columns == docs.columns
    every = {r[0] for r in rows}
    assert set(kept[0]) == every - {103, 104}
    assert set(kept[1]) == every - {103, 104, 100, 101}
    assert set(kept[2]) == every - {103, 104, 100, 101, 102} == set(kept[3]) == set(kept[4])
    assert kept[3][105]["text"].endswith("<secret>") and kept[3][5]["text"] == kept[2][5]["text"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, current.collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids, repeated rows, a very long text, and columns
    with names that stages use inside."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "wh", "tion"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    twice = (7, text(60), "en", "a", 1, "x", "y", 1.0)
    rows = [(i, text(50), "en", "a", 1, "x", "y", 1.0) for i in range(6)] + [twice, twice, (None, text(60), "en", None, 1, "x", "y", 1.0), (None, text(70), None, "b", None, None, None, None)]
    rows += [(20, text(120_000), "en", "b", 1, "x", "y", 1.0), (21, "", "en", "b", 0, "x", "y", 1.0), (22, None, None, None, None, None, None, None), (23, "Thtion.", None, "b", 7, "x", "y", 1.0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, base string, spans string, score double"
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0
        current = common.cut(stage(spark, current, str(tmp_path)))
        kept.append(sorted(str(r["doc_id"]) for r in current.collect()))
        if stage is not corpus_pipeline.mixed:
            assert current.columns == docs.columns == nothing.columns
            assert current.where("doc_id is not null and doc_id < 6 and not (base <=> 'x' and spans <=> 'y')").count() == 0
    every = sorted(str(r[0]) for r in rows)
    assert kept[0] == [x for x in every if x not in ("21", "22")]
    assert kept[1] == [x for k, x in enumerate(kept[0]) if x != "7" or kept[0].index("7") == k] == kept[2] == kept[3] == kept[4]


def test_languages_that_are_rejected(spark):
    """Texts of no language go once there is enough of them to tell; short
    ones and texts in two languages stay, with one language or with many."""
    rng = random.Random(5)
    parts = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "zu", "ung", "ei"], "fr": ["eau", "qui", "ais", "mo"]}
    text = lambda x, n=80: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    odd = " ".join("".join(rng.choice("qxjkvz") for _ in range(6)) for _ in range(60))
    for langs in (["en"], ["en", "de", "fr"]):
        rows = [(i, text(x), x) for x in langs for i in range(30)]
        rows += [(100, odd, None), (101, odd[:20], None), (102, f"{text(langs[0])} {text(langs[-1])}", None), (103, "12 !?", None), (104, "жизнь " * 30, None)]
        docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.identify(spark, docs, "").collect()
        assert sorted(r["doc_id"] for r in kept if r["doc_id"] >= 100) == [101, 102] and len(kept) == 30 * len(langs) + 2


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def plain_grams(text):
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text or ''} ")
    return [folded[i : i + 4] for i in range(len(folded) - 3) if folded[i : i + 4].strip()]


def plain_identify(docs):
    known = {}
    for r in docs:
        if r["lang"] and r["text"]:
            known.setdefault(r["lang"], set()).update(plain_grams(r["text"]))
    for r in docs:
        grams = plain_grams(r["text"])
        hits = {x: sum(g in s for g in grams) for x, s in known.items()}
        if any(c.isalpha() for c in r["text"] or "") and not (len(grams) >= 40 and max(hits.values()) < 0.03 * len(grams)):
            yield r | {"lang": max(sorted(hits), key=hits.get)}


def plain_distinct(docs):
    docs = list(docs)
    sets = []
    for r in docs:
        w = (r["text"] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda k: docs[k]["doc_id"])
                up[y] = x
    return [r for k, r in enumerate(docs) if find(k) == k]


def plain_clean(docs, items):
    def normal(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).strip()

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            before, row[0] = row[:], i + 1
            for j, d in enumerate(text):
                row[j + 1] = min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1)
        return min(row)

    return [r for r in docs if not any(normal(t) and least(normal(t), normal(r["text"])) <= len(normal(t)) // 10 for t in items)]


def plain_redact(docs):
    kinds = (
        (r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
        (r"AKIA[A-Z0-9]+", 0, 16),
        (r"[0-9a-f]+", 0, 32),
    )
    for r in docs:
        spans = sorted(m.span() for pattern, group, size in kinds for m in re.finditer(pattern, r["text"] or "") if len(m.group(group)) >= size)
        out, at = "", 0
        for a, b in spans:
            out, at = (out + r["text"][at:a] + "<secret>", b) if a >= at else (out, max(at, b))
        text = out + r["text"][at:]
        yield r | {"text": text, "n_chars": len(text)}


def test_whole_pipeline_against_plain_stages(spark, tmp_path):
    """Languages by sets, all pairs of texts, edit distances by the plain
    recurrence, patterns by Python's, the mix by SQL: the same rows."""
    rng = random.Random(31)
    parts = {"en": ["th", "ing", "er", "wh", "tion", "on"], "de": ["sch", "zu", "ung", "ei", "ver", "ß"]}
    text = lambda x, n=30: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [text("en", 8), text("de", 9), "a short", None]
    rows = [(i, text(x), x if i % 3 else None, f"s{i % 3}") for i in range(90) for x in [rng.choice(["en", "de"])]]
    for k in range(100, 130):  # near copies of all degrees, some of copies
        _, t, x, s = rng.choice(rows)
        words = t.split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = text("en", 1)
        rows.append((k, " ".join(words), x, s))
    for k, t in enumerate(items[:2] * 3):  # with more and more edits
        hit = list(t.upper() if k % 2 else t)
        for _ in range(2 * k):
            hit[rng.randrange(len(hit))] = "q"
        x = "de" if k % 2 else "en"
        rows.append((200 + k, f"{text(x, 12)}. {''.join(hit)}! {text(x, 12)}", None, "s1"))
    rows += [(300, text("de") + ' api_key: "abcd.efgh-1234" and ' + "0f" * 20, "de", "s1"), (301, text("en") + " AKIA" + "Q7" * 8 + " token=short", "en", None), (302, "xqv kjz " * 30, None, "s0"), (303, "7 8 9", None, "s0"), (304, None, None, "s2"), (305, "", "en", "s2")]
    docs = [{"doc_id": i, "text": t, "lang": x, "source": s, "n_chars": len(t) if t is not None else None} for i, t, x, s in rows]
    spark.createDataFrame([tuple(r.values()) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = [list(plain_identify(docs))]
    steps.append(plain_distinct(steps[0]))
    steps.append(plain_clean(steps[1], items))
    steps.append(list(plain_redact(steps[2])))
    assert [len(x) for x in steps] == sorted([len(x) for x in steps], reverse=True) and len(docs) > len(steps[0]) > len(steps[1]) > len(steps[2]) > 80
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        current = common.cut(stage(spark, current, str(tmp_path)))
        assert sorted((r.asDict() for r in current.collect()), key=str) == sorted(want, key=str), name
    duck = duckdb.connect()
    duck.register("kept", current.toPandas())
    want = duck.sql(mixing.SQL.format(docs="kept", columns="source, ")).df()
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    columns = sorted(set(got.columns) & set(want.columns))
    tidy = lambda df: df[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True)
    assert {"doc_id", "size", "target", "taken"} <= set(columns) and tidy(got).equals(tidy(want))
