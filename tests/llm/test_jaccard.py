import random

from skyweave.llm import jaccard


def grams(text):
    w = [x.lower() for x in (text or "").split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    out = []
    for k in range(25):
        base = [word() for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += ["one two", "ONE\ttwo", "a b c d", "a b c d e", "", None, "  \n "]
    big = [word() for _ in range(200)]
    for k in range(30):
        own = list(big)
        own[k * 3] = "x"
        out.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [rows[3], rows[3], (None, "null id text here now"), (None, "null id text here now")]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    # At last, every group is a giant, taken apart by tree and prefix.
    for how in ({}, {"block": 7}, {"block": 7, "giant": 2}):
        found = jaccard.join(docs, **how).collect()
        assert len(found) == len(rows)
        sets = [grams(t) for _, t in rows]
        links, up = [0] * len(rows), list(range(len(rows)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                    links[a] += 1
                    links[b] += 1
                    up[find(a)] = find(b)
        low = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                low[find(i)] = min(low.get(find(i), d), d)
        expected = sorted((str(d), links[i], str(low.get(find(i)))) for i, (d, _) in enumerate(rows))
        assert sorted((str(r["doc_id"]), r["n_links"], str(r["class_id"])) for r in found) == expected
    kept = jaccard.distinct(docs).collect()
    classes = {find(i) for i in range(len(rows))}
    assert len(kept) == len(classes) and docs.columns == jaccard.distinct(docs).columns


def test_one_row_of_each_class_that_shares_its_class_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = lambda t: t + " end"
    rows = [(None, a), (None, near(a)), (None, b), (None, near(b)), (5, c), (7, near(c)), (5, d), (8, near(d)), (5, "alone")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [5, 5, 5] and {t for i, t in kept if i == 5} == {c, d, "alone"}
    assert sorted(t[0] for i, t in kept if i is None) == ["a", "b"]


def test_recall_below_and_at_the_threshold(spark):
    """Pairs of known similarity: all at the threshold and above are linked,
    none below, among them one of very long texts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, expected = [], {}
    for k in range(300):
        n = 100_000 if k == 0 else rng.randint(60, 200)
        base = [word() for _ in range(n)]
        grams_ = n - 4
        # Cutting c words off the end leaves a similarity of (n - 4 - c) / (n - 4).
        c = int(grams_ * rng.choice([0.05, 0.15, 0.2, 0.205, 0.25, 0.4])) + rng.randint(0, 1)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - c]))]
        expected[2 * k] = int(5 * (grams_ - c) >= 4 * grams_)
    found = {r["doc_id"]: r["n_links"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: found[k] for k in expected} == expected and 100 < sum(expected.values()) < 250


def test_trees_for_a_recall():
    for t in (0.5, 0.8, 0.95):
        n = jaccard.trees_for(t, 0.9999)
        assert 1 - (1 - t**jaccard.SHALLOW) ** n >= 0.9999 > 1 - (1 - t**jaccard.SHALLOW) ** (n - 1)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hard_pairs_beside_a_large_cluster(spark):
    """Pairs just at the threshold are found whatever else the table holds,
    and in a group of near copies too."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, n = [], 104
    for k in range(600):
        base = [word() for _ in range(n)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - 20]))]  # 80 of 100 grams
    copy = [word() for _ in range(200)]
    rows += [(5000 + k, " ".join([*copy, word()])) for k in range(1200)]
    rows += [(9000, " ".join(copy[: 4 + 158]))]  # 158 of 197 grams
    found = {r["doc_id"]: r["n_links"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k] for k in range(600)) == 600
    assert found[9000] == 1200 and {found[5000 + k] for k in range(1200)} == {1200}
