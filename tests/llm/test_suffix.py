import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skyweave.llm import suffix


def table():
    rng = random.Random(8)
    unit = ["tha", "ing", "er", "on", "zu", "é"]
    text = lambda: " ".join("".join(rng.choice(unit) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 120)))
    return [(i, text()) for i in range(150)] + [(500, None), (501, ""), (502, "A\tB\x0bc d"), (503, "rare WORDS only"), (503, "rare WORDS only"), (None, "tha ing")]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_score_and_probabilities(spark):
    rows = table()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    train = docs.where("doc_id < 100 or doc_id is null")
    for frequent in (1 << 21, 20):
        tree, words = suffix.learn(train, frequent=frequent)
        found = suffix.score(docs, tree, words).collect()
        count = Counter(w for i, t in rows if i is None or i < 100 for w in tokens(t))
        n, v = sum(count.values()), len(count)
        expected = sorted((str(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    # The tree by plain definition, and the score along each text.
    count = Counter()
    sym = lambda t: [suffix.END] * suffix.DEPTH + [suffix.GAP if b == 32 else b for b in b" ".join(tokens(t)[:-1])] + [suffix.END]
    for i, t in rows:
        if i is None or i < 100:
            s = sym(t)
            for k in range(suffix.DEPTH, len(s)):
                for d in range(suffix.DEPTH + 1):
                    count[tuple(s[k - d : k]), s[k]] += 1
    all_, after = Counter(), {}
    for (c, x), m in count.items():
        all_[c] += m
        after.setdefault(c, {})[x] = m
    least = 10
    kept = {()}
    for c in after:
        up = c[1:]
        if c and all_[c] >= least and sum(m * math.log(m / all_[c] / (after[up][x] / all_[up])) for x, m in after[c].items()) >= 10:
            kept.update(c[k:] for k in range(len(c)))
    used = len(suffix.USED)

    def chance(c, x):
        if not c:
            return (after[c].get(x, 0) + 1) / (all_[c] + used)
        return (after[c].get(x, 0) + 6 * chance(c[1:], x)) / (all_[c] + 6) if c in kept else chance(c[1:], x)

    assert len(kept) > 30 and max(map(len, kept)) == suffix.DEPTH
    for c in sorted(kept)[::7]:
        assert abs(sum(chance(c, int(x)) for x in suffix.USED) - 1) < 1e-9
    for i, t in rows[:20] + rows[-3:]:
        s = sym(t)
        total = sum(math.log10(chance(tuple(s[k - suffix.DEPTH : k]), s[k])) for k in range(suffix.DEPTH, len(s)))
        got = [r["score"] for r in found if r["doc_id"] == i]
        assert all(abs(g - total) < 1e-3 for g in got), (i, got, total)


def test_parts_and_other_scripts(spark):
    """A tree in many parts scores as one at hand; bytes of every script are
    symbols of their own; a very long text is scored whole."""
    docs = spark.createDataFrame([(i, f"слово номер {i % 7} и ещё одно слово " * 9) for i in range(60)] + [(100, "слово " * 100_000), (101, "zzz " * 50), (102, None), (102, None)], "doc_id long, text string")
    train = docs.where("doc_id < 50")
    whole, words = suffix.learn(train)
    small, _ = suffix.learn(train, bound=8)
    assert whole.blocks == 1 and small.blocks >= 3
    kept = [set(small.tree(k).keys.tolist()) for k in range(small.blocks)]
    assert set.union(*kept) == set(whole.tree().keys.tolist()) and sum(map(len, kept)) == len(whole.tree().keys) and sum(map(bool, kept)) >= 2
    score = sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 4)) for r in suffix.score(docs, whole, words).collect())
    assert score == sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 4)) for r in suffix.score(docs, small, words).collect())
    per = {i: x / n for i, n, _, _, x in score}
    assert per[55] > per[101] and per[100] > per[101] and len(score) == 64


def test_what_is_kept_is_kept_of_more(spark):
    rows = [(i, t) for i, t in table() if t]
    few, _ = suffix.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    more, _ = suffix.learn(spark.createDataFrame(rows * 3, "doc_id long, text string"))
    nodes = lambda m: {(d, r["c"]) for d, x in m.keeps.items() for r in x.collect()}
    assert nodes(few) < nodes(more)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    tree, words = suffix.learn(none)
    assert suffix.score(none, tree, words).count() == 0
    some = suffix.score(none.union(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), tree, words).first()
    assert some["n_known"] == 0 and some["n_tokens"] == 3 and some["score"] < 0
