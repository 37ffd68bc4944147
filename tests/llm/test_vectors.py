import numpy as np

from skyweave.llm import vectors


def table():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = []
    for k in range(400):
        v = base[k % 60] + rng.standard_normal(16) * 0.12 * (k % 3)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 4))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, rows[0][1], None), (1004, None, 0), (1005, [0.0] * 16, 0)]
    rows += [(1006, [float("nan")] * 16, 0), (1007, [1.0] * 8, 0), (1007, [1.0] * 8, 0), (1008, [None] * 16, 0), (1009, [], 0), (1010, [float("inf")] * 16, 0)]
    return rows


def brute(rows):
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None for r in rows]
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return sorted((r[0], links[i], min(rows[j][0] for j in range(n) if find(j) == find(i))) for i, r in enumerate(rows))


def test_against_all_pairs(spark):
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for how in ({}, {"block": 16}):
        found = vectors.near(df, **how).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert vectors.near(df.limit(0)).count() == 0


def test_recall_at_depth_ten(spark):
    """Trees ten and more levels deep, of which the sample fits five: of the
    links that all pairs of every row with a fixed share of the ids have, nine
    in ten at least are found."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((5000, 64))
    v = np.concatenate([base + rng.standard_normal(base.shape) * 0.2 * k / 3 for k in range(4)]).astype(np.float32)
    n = len(v)
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r["n_links"] for r in vectors.near(df, leaf=16, sample=3000).select("vec_id", "n_links").collect()}
    asked = np.arange(0, n, 100)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    exact = (unit[asked] @ unit.T >= 0.93).sum(1) - 1
    got = np.array([found[k] for k in asked])
    assert (got <= exact).all() and exact.sum() > 300
    recall = got.sum() / exact.sum()
    print("recall at depth", int(np.ceil(np.log2(n / 16))), recall)
    assert recall >= 0.9


def test_null_ids(spark):
    v = [float(k) for k in range(1, 9)]
    df = spark.createDataFrame([(None, v, 1), (None, v[:-1] + [8.1], 1), (7, v, 2), (None, v, 2)], "vec_id long, embedding array<double>, label int")
    assert sorted((str(r[0]), r[1], str(r[2])) for r in vectors.near(df).collect()) == [("7", 1, "7"), ("None", 1, "7"), ("None", 1, "None"), ("None", 1, "None")]


def test_clashing_names_and_repeats_without_a_label(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v, None, 7, 0), (1, v, None, 7, 0), (2, v, 5, 7, 1), (3, [1.0, 2.0, 3.01], 5, 8, 2), (4, w, 5, 9, 3), (3, [1.0, 2.0, 3.01], 5, 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int, n_links int")
    found = sorted(tuple(r) for r in vectors.near(df).collect())
    assert found == [(1, 0, 1, True), (1, 0, 1, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True)]
