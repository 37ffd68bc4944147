"""Centroid clustering of whole-number vectors, filtered by an n-simplex
projection.

The distances of a vector to a few pivots are the edges of a simplex over
theirs; its apex, as many coordinates as there are pivots, is computed once
and kept beside the vector. The distance of two apexes bounds that of the
vectors from below, and from above with one last coordinate mirrored. A
centroid whose lower bound is above another's upper bound is passed over; the
others are compared exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut

#: Components lie within this, so that squared distances of 64 fit into a long.
LIMIT = 1 << 27
#: Pivots at most, how far one must lie off the others' simplex, in parts of
#: its size, and what rounding may add to a bound, in parts of its square.
PIVOTS, APART, SLACK = 12, 0.05, 1e-6
_ROWS = 512


class Simplex:
    """Pivots, chosen from ``points`` one after the other, each the one
    farthest from the simplex of those before."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        self.pivots, self.base = points[:1], np.zeros((1, 0))
        while len(self.pivots) < min(most, len(points)):
            apex = self.apex(points)
            best = int(apex[:, -1].argmax())
            size = np.sqrt(max(self._squares(points).max(), 1.0))
            if apex[best, -1] <= APART * size:
                break
            self.base = np.vstack((np.pad(self.base, ((0, 0), (0, 1))), apex[best]))
            self.pivots = np.vstack((self.pivots, points[best]))

    def _squares(self, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), len(self.pivots)))
        for k, p in enumerate(self.pivots):
            d = (points - p).astype(np.float64)
            out[:, k] = np.einsum("ij,ij->i", d, d)
        return out

    def apex(self, points: np.ndarray) -> np.ndarray:
        """Coordinates of ``points`` over the base: one for each pivot, the
        last the height over it."""
        square = self._squares(points)
        first = square[:, :1]
        right = ((self.base[1:] ** 2).sum(1) + first - square[:, 1:]) / 2
        low = np.linalg.solve(self.base[1:], right.T).T if len(self.pivots) > 1 else np.zeros((len(points), 0))
        height = np.sqrt(np.maximum(first - (low**2).sum(1, keepdims=True), 0.0))
        return np.hstack((low, height))

    def may_be_nearest(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of the centroids with apexes ``c`` may be the nearest of each
        of ``a``."""
        flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
        lower = flat + (a[:, None, -1] - c[None, :, -1]) ** 2
        upper = flat + (a[:, None, -1] + c[None, :, -1]) ** 2
        size = max((a**2).sum(1).max(initial=0.0), (c**2).sum(1).max())
        return lower <= upper.min(1, keepdims=True) + SLACK * size


def whole(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` of the rows whose ``embedding`` has exactly ``dim``
    components, none null or not finite: ``v`` holds ``floor(scale * x)`` as
    32-bit numbers, clamped to ±2**27."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
            ids, lists = batch.column(0).filter(some), batch.column(1).filter(some)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                v = np.floor(np.clip(scale * x[good], -LIMIT, LIMIT)).astype("<i4")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "v"])

    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("e")).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length, as they stand in a column of bytes."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def nearest(v: np.ndarray, apex: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid, the smaller number where two are
    as near, and its squared distance; and how many pairs were compared."""
    to = simplex.apex(centroids)
    label, least, pairs = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), 0
    for a in range(0, len(v), _ROWS):
        part = v[a : a + _ROWS].astype(np.int64)
        row, col = np.nonzero(simplex.may_be_nearest(apex[a : a + _ROWS], to))
        d = part[row] - centroids[col]
        square = np.full((len(part), len(centroids)), np.iinfo(np.int64).max)
        square[row, col] = np.einsum("ij,ij->i", d, d)
        label[a : a + _ROWS] = best = square.argmin(1)
        least[a : a + _ROWS] = square[np.arange(len(part)), best]
        pairs += len(row)
    return label, least, pairs


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256)`` for each row that :func:`whole` keeps.

    Centroids begin as the ``k`` vectors of least SHA-256 of ``salt`` and id.
    In each round every vector goes to the nearest, the smaller number where
    two are as near, and a centroid becomes the floor of its vectors' mean in
    each component; one without vectors stays. After the rounds vectors are
    dealt once more. Rows that repeat an id or a vector count each. A row
    without an id begins no centroid; where there is none, all but the id is
    null. An empty table stays empty; other columns do not matter.

    A round is one pass over the kept table; what leaves a task is sums, ``k *
    (dim + 1)`` rows, and as many in all come to the driver. Sums beyond the
    longest long are given as that."""
    spark = vectors.sparkSession
    rows = whole(vectors, dim, scale)
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = rows.where("vec_id is not null").orderBy(order, "v").limit(k).collect()
    if not seeds:
        kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    centroids = np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in seeds]).astype(np.int64)
    simplex = Simplex(centroids)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), "<i4")
            apex = [simplex.apex(v[a : a + _ROWS].astype(np.int64)).astype("<f8") for a in range(0, len(v), _ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for part in apex for r in part], pa.binary())], names=["vec_id", "v", "apex"])

    kept = cut(rows.mapInArrow(project, "vec_id long, v binary, apex binary"))

    def sums(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), dim + 1), np.int64)
            for batch in batches:
                v = _matrix(batch.column(0), "<i4")
                label, _, _ = nearest(v, _matrix(batch.column(1), "<f8"), simplex, centroids)
                for c in np.unique(label):
                    mine = v[label == c]
                    total[c, :dim] += mine.sum(0, dtype=np.int64)
                    total[c, dim] += len(mine)
            some = np.flatnonzero(np.repeat(total[:, dim] > 0, dim + 1))
            yield pa.RecordBatch.from_arrays([pa.array((some // (dim + 1)).astype(np.int32)), pa.array((some % (dim + 1)).astype(np.int32)), pa.array(total.ravel()[some])], names=["cluster", "at", "total"])

        return run

    for _ in range(rounds):
        parts = kept.select("v", "apex").mapInArrow(sums(centroids), "cluster int, at int, total long")
        total = [[0] * (dim + 1) for _ in centroids]
        for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k * (dim + 1) rows at most
            total[r["cluster"]][r["at"]] = int(r["total"])
        centroids = np.array([[s // t[dim] for s in t[:dim]] if t[dim] else old.tolist() for t, old in zip(total, centroids)], np.int64)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, least, _ = nearest(_matrix(batch.column(1), "<i4"), _matrix(batch.column(2), "<f8"), simplex, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    done = cut(kept.mapInArrow(last, "vec_id long, cluster int, distance long"))
    own = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # one row a centroid
    most = (1 << 63) - 1
    table = [(r["cluster"], min(most, int(r["own"])), min(most, int(sum(x["own"] for x in own))), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in own]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same in DuckDB, every vector against every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"seeds AS (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), r) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        f"x AS MATERIALIZED (SELECT r, i, v[i] AS x FROM v, (SELECT unnest(range(1, {dim + 1})) AS i))",
        f"c0 AS MATERIALIZED (SELECT c, i, v[i] AS x FROM seeds, (SELECT unnest(range(1, {dim + 1})) AS i))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, c, CAST(sum((x.x - m.x) * (x.x - m.x)) AS BIGINT) AS d FROM x JOIN c{n} m USING (i) GROUP BY r, c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            mean = "(sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"m{n} AS (SELECT c, i, CAST({mean} AS BIGINT) AS x FROM a{n} JOIN x USING (r) GROUP BY c, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN m{n} m ON m.c = o.c AND m.i = o.i)")
    return f"""WITH {', '.join(steps)}, named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS name FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN named USING (c)"""
