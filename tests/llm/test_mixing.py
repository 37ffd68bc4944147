import hashlib
import re

from skyweave.llm import mixing


def brute(rows):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    total = {}
    for _, s, n in sized:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, left, target = set(order), 1.5 * sum(total.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * total[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.remove(s)
    return sized, total, target


ROWS = [(i, "w " * (i * 7 % 23), f"s{i % 5}") for i in range(200)] + [(1000 + i, "a b c\x0bd", "s0") for i in range(300)]
ROWS += [(None, "x y", None), (7, None, None), (8, "", "zero"), (7, "w " * 3, "s1"), (7, "w " * 3, "s1")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    sized, total, target = brute(ROWS)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in out) == sorted((str(a), str(b), c) for a, b, c in sized)
    largest = {s: max(n for _, t, n in sized if t == s) for s in total}
    for s in total:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == total[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= largest[s]
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_draw_is_md5(spark):
    d = spark.createDataFrame([(5, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    by = lambda b: hashlib.md5(b).hexdigest()
    assert {r[0] for r in d.select(mixing.draw(d, "mix")).collect()} == {by(b"mix:5"), by(b"mix:null " + by(b"x").encode()), by(b"mix:null " + by(b"").encode())}


def test_very_long_texts_and_names_in_use(spark):
    """One text of a million words among short ones, and columns named as the
    operator's own."""
    rows = [(1, "w " * 1_000_000, "a", 0.5, "p")] + [(k, "w x", "b", 0.5, "p") for k in range(2, 50)]
    out = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target double, _place string")).collect()}
    assert out[1]["size"] == 1_000_000 and out[1]["taken"] <= 2_000_000 and len(out) == 49
    assert all(r["target"] == 2 * r["source_size"] for r in out.values() if r["source"] == "b")
