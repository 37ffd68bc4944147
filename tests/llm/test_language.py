import random

import numpy as np
from pyspark.sql import functions as F

from skyweave.llm import language, queries

EN = "the cat and the dog were walking through the garden when that other thing happened with them"
DE = "der hund und die katze gingen durch den garten und sahen dort eine schöne alte brücke über dem fluss"


def rows():
    out = []
    for i in range(40):
        a, b = EN.split(), DE.split()
        k = i % len(a)
        out += [(i, " ".join(a[k:] + a[:k]), "en", 1), (100 + i, " ".join(b[k:] + b[:k]), "de", 1)]
    return out


def test_learns_and_predicts(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    assert model.langs == ("de", "en")
    seen = spark.createDataFrame(
        [(1, "the garden and the dog", 0), (2, "und der garten durch die brücke", 0), (3, None, 0), (4, "12 !?", 0), (5, "", 0), (1, "the garden and the dog", 0), (None, "the other thing " * 60_000, 0), (7, "é", 0)],
        "doc_id long, text string, score int",
    )
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(seen, model).collect()]
    assert [x[1] for x in found[:7]] == ["en", "de", "und", "und", "und", "en", "en"]
    assert found[7][1] in ("de", "en") and all(0 <= x[2] <= 1 for x in found) and found[0][2] == found[5][2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(none)
    assert model.langs == ()
    assert language.predict(none, model).count() == 0
    some = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert language.predict(some, model).first()["lang_pred"] == "und"


def test_counts_against_plain_sets(spark):
    """The filter's counts are those of exact sets of n-grams but for chance
    hits; a text longer than a block counts as it does in one piece."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    own = {"en": {}, "de": {}}
    for _, t, x, _ in rows():
        for g in {g for g in plain(t)}:
            own[x].setdefault(g, [0, 0])[0] += 1
        for g in plain(t):
            own[x][g][1] += 1
    size = {x: sum(c for d, c in v.values() if d >= 3) for x, v in own.items()}
    rate = lambda x, g: own[x].get(g, [0, 0])[1] / size[x] if own[x].get(g, [0, 0])[0] >= 3 else 0
    sets = {x: {g for g in own[x] if rate(x, g) and rate(x, g) >= 0.5 * max(rate(y, g) for y in own)} for x in own}
    text = ("the brücke was open and die katze sahen it, " * 40).strip()
    expected = [sum(g in sets[x] for g in plain(text)) for x in model.langs]
    data = np.frombuffer(text.encode(), np.uint8)
    whole = language._judge(model, np.array([0, len(data)]), data)
    pieces = language._judge(model, np.array([0, len(data)]), data, limit=101)
    assert [float(x[0]) for x in whole] == [float(x[0]) for x in pieces]
    assert whole[2][0] == len(plain(text)) and abs(whole[3][0] - max(expected)) <= 1 and abs(whole[4][0] - min(expected)) <= 1


def plain(text):
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
    return [folded[i : i + 4] for i in range(len(folded) - 3) if folded[i : i + 4].strip()]


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    parts = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for _ in range(90)]
    text = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(30))
    docs = spark.createDataFrame([(k * 10 + i, text(k), f"l{k:02d}") for k in range(90) for i in range(8)], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 10 < 6"))
    assert len(model.langs) == 90
    held = language.predict(docs.where("doc_id % 10 >= 6"), model)
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()


def test_held_out_accuracy(spark):
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = found.where("held_out").join(docs.where("lang is not null"), "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert row[0] >= 0.98 and row[1] > 100


def test_a_language_with_two_labelled_texts(spark):
    """It is predicted, the pipeline keeps its texts, and texts of which no
    n-gram is known have score 0."""
    import corpus_pipeline

    rng = random.Random(12)
    parts = {"big": ["th", "ing", "er", "wh", "tion", "on", "at"], "few": ["kw", "zo", "ujj", "ya", "pli", "ov"]}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(60))
    rows = [(i, text("big"), "big", "a", 1) for i in range(50)] + [(100 + i, text("few"), "few" if i < 2 else None, "a", 1) for i in range(12)]
    rows += [(200, "ßäöü " * 3, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in language.predict(docs.drop("lang"), language.fit(docs)).collect()}
    assert {found[100 + i]["lang_pred"] for i in range(12)} == {"few"} and {found[i]["lang_pred"] for i in range(50)} == {"big"}
    assert found[200]["score"] == 0.0 and found[200]["lang_pred"] == "big"
    kept = {r["doc_id"] for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows}
