"""Clusters by filtered comparison against all comparisons."""

import hashlib

import numpy as np
import pytest

from skyweave.llm import centroids
from skyweave.llm.centroids import LIMIT, Simplex, nearest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5, dim=64):
    kept = [(i, [min(max(int(np.floor(256.0 * float(np.float32(x)))), -LIMIT), LIMIT) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes()) for i, v in kept if i is not None)[:k]
    cents = [list(map(int, np.frombuffer(b, "<i4"))) for _, b in seeds]
    if not cents:
        return sorted((i, None, None, None, None, None) for i, _ in kept)
    v = np.array([x for _, x in kept], np.int64)
    for r in range(rounds + 1):
        d = ((v[:, None] - np.array(cents, np.int64)[None]) ** 2).sum(2)
        label, least = d.argmin(1), d.min(1)
        if r < rounds:
            for c in range(len(cents)):
                mine = v[label == c]
                if len(mine):
                    cents[c] = [int(s) // len(mine) for s in mine.sum(0)]
    own = {c: int(least[label == c].sum()) for c in set(label.tolist())}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, int(c), int(d), own[int(c)], int(least.sum()), name[c]) for (i, _), c, d in zip(kept, label, least)]


def same(spark, rows, schema=SCHEMA, **how):
    key = lambda r: tuple((x is not None, x) for x in r)
    found = sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, schema), **how).collect()), key=key)
    assert found == sorted(brute([r[:2] for r in rows], **how), key=key)


def vectors(seed, n, dim=64, groups=6):
    draw = np.random.default_rng(seed)
    mid = draw.normal(size=(groups, dim))
    return [(i, (mid[i % groups] + 0.2 * draw.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,rounds,dim", [(40, 5, 64), (7, 2, 3)])
def test_same_as_all_comparisons(spark, k, rounds, dim):
    same(spark, vectors(k, 400, dim), k=k, rounds=rounds, dim=dim)


def test_ties_repeats_and_few(spark):
    rows = [(i, [float(i % 4 // 2), 0.0]) for i in range(30)] + [(3, [1.0, 0.0])] * 2
    same(spark, rows, k=9, rounds=3, dim=2)
    same(spark, [(1, [0.5, 0.25])], k=5, rounds=2, dim=2)
    same(spark, [(i, [float(i), 2.0 * i]) for i in range(20)], k=6, rounds=4, dim=2)  # on one line


def test_odd_rows(spark):
    good = vectors(3, 50)
    bad = [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    big = [(906, [3e38] * 64), (907, [-3e38] * 64), (908, [-0.001] * 64), (None, [0.3] * 64)]
    same(spark, good + bad + big)
    same(spark, [(None, [0.5] * 64)])
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    same(spark, [(i, v, i, "x") for i, v in good], SCHEMA + ", cluster int, v string")


def test_bounds_hold_and_filter():
    draw = np.random.default_rng(4)
    mid = 100 * draw.normal(size=(12, 64))
    v = np.floor(mid[draw.integers(0, 12, 2000)] + 9 * draw.normal(size=(2000, 64))).astype(np.int64)
    cents = v[:40]
    simplex = Simplex(cents)
    a, c = simplex.apex(v), simplex.apex(cents)
    d = ((v[:, None] - cents[None]) ** 2).sum(2)
    low = ((a[:, None] - c[None]) ** 2).sum(2)
    high = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2) + (a[:, None, -1] + c[None, :, -1]) ** 2
    assert (low <= d + 1e-6 * d.max()).all() and (d <= high + 1e-6 * d.max()).all()
    label, least, pairs = nearest(v, a, simplex, cents)
    assert (label == d.argmin(1)).all() and (least == d.min(1)).all()
    assert pairs < d.size / 4
