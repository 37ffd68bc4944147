"""Embedding near-deduplication by a random-projection tree forest.

Each tree splits the vectors of a label by random projections, level after
level, near the median; vectors near a split go to both sides (spill). The
more vectors a label has, the deeper its trees. Vectors that share a leaf of
any tree are compared, pairs at or above the threshold are links, and links
are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .blocks import Labels, deal
from .common import components, cut, grouped


@dataclass(frozen=True)
class Forest:
    """``directions[tree, level]``; for each tree and level the places of the
    splits and half the widths of their spill: of every node as far as
    ``fitted`` levels, below of every node at level ``fitted``, for all that
    are under it."""

    directions: np.ndarray
    fitted: int
    splits: list
    widths: list

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of all leaves that the rows of ``x`` fall into, each
        at its own ``depth``; leaf ids differ between trees. A tree without a
        split is the same as any other: there is one."""
        rows, ids = [], []
        for t in range(len(self.directions)):
            row = np.flatnonzero(depth >= (1 if t else 0))
            node = np.zeros(len(row), np.int64)
            for level, d in enumerate(self.directions[t]):
                go = depth[row] > level
                rows.append(row[~go])
                ids.append(node[~go] + (np.int64(t) << 48))
                row, node = row[go], node[go]
                if not len(row):
                    break
                p = np.einsum("ij,j->i", x[row], d)
                at = node >> max(0, level - self.fitted)
                split, width = self.splits[t][level][at], self.widths[t][level][at]
                left, right = p < split + width, p >= split - width
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            ids.append(node + (np.int64(t) << 48))
        return np.concatenate(rows), np.concatenate(ids)


def fit(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int, least: int = 64) -> Forest:
    """Splits at the median of each node's sample; the spill's width leaves a
    share ``spill`` of it on both sides, or less in deep trees: a vector is to
    have two leaves of a tree at most, on average. Where nodes have under ``least``
    sampled vectors on average, the level's splits are those of the last level
    above with more: what is broadcast does not grow beyond that, and there is
    spill at every depth."""
    rng = np.random.default_rng(seed)
    spill = min(spill, np.log(2) / max(1, depth))
    dim = sample.shape[1] if sample.size else 1
    directions = rng.standard_normal((trees, depth, dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    fitted = int(np.log2(max(1, len(sample) // least)))
    splits, widths = [], []
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        splits.append([])
        widths.append([])
        for level in range(depth):
            nodes = 1 << min(level, fitted)
            p = sample @ directions[t, level] if len(sample) else np.zeros(0)
            split, width = np.full(nodes, np.median(p) if len(p) else 0.0), np.zeros(nodes)
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange(nodes + 1))
            for k in range(nodes):
                mine = p[order[edges[k] : edges[k + 1]]]
                if len(mine):
                    split[k] = np.median(mine)
                    width[k] = np.quantile(np.abs(mine - split[k]), spill)
            splits[t].append(split)
            widths[t].append(width)
            if level < fitted:
                node = 2 * node + (p >= split[node])
    return Forest(directions, fitted, splits, widths)


def near(
    table: DataFrame, threshold: float = 0.93, trees: int = 12, leaf: int = 48, spill: float = 0.1, sample: int = 20_000, block: int = 1024, seed: int = 7
) -> DataFrame:
    """One row for each row of ``table(vec_id, embedding, label)``: ``vec_id,
    n_links, component_id, kept``.

    Vectors with equal label are linked where their cosine, computed in double
    precision, is at least ``threshold`` and they share a leaf of one of the
    ``trees``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id that links reach, ``kept`` says whether it
    is the row's own. Null labels, and vectors that are null, zero, or have
    null, NaN or infinite components link with nothing; vectors of different
    lengths never link. Equal vectors of a label are taken together first, so
    copies cost nothing. Rows with the same id are one member for
    ``component_id``, and each other's links where their vectors are linked; a
    null id is no one's ``component_id`` unless all it is linked with are null.

    The forest is fitted on a bounded sample, about ``sample`` vectors, those
    whose digests are lowest; every vector is filed in it. The depth of a
    label's trees grows with its vectors, so that leaves hold about ``leaf`` of
    them at any size; a label with no more than that is compared whole. A leaf
    of more than ``block`` is compared block by block. A pair that shares
    several leaves counts at the first of them alone."""
    spark = table.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    whole = table.select("vec_id", "label", e.alias("embedding"), sound.alias("sound"))
    # Two digests of 64 bits: equal ones stand for equal vectors.
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "embedding")), 16, "0")
    rows = whole.withColumn("node", F.when(F.col("sound"), F.unhex(F.concat(half(1), half(2)))))
    slim = cut(rows.select("vec_id", "node"))
    copies = cut(rows.where("sound").groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    labels = cut(copies.groupBy("label").agg(F.count("*").alias("n")).withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(leaf))))).cast("int")))
    size = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first()
    place = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30))
    share = min(1.0, sample / max(1, size["n"])) if size["depth"] else 0.0
    vectors = [r[0] for r in copies.where(place < int(share * (1 << 30))).select("embedding").collect()]  # about ``sample``
    dims = sorted({len(v) for v in vectors})
    how = (trees, size["depth"], spill, seed)
    shared = spark.sparkContext.broadcast(({d: fit(_unit(np.array([v for v in vectors if len(v) == d], np.float64)), *how) for d in dims}, how))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, how = shared.value
        for batch in batches:
            embedding = batch.column(2)
            sizes = np.array(embedding.value_lengths())
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                take = pa.array(at)
                x = _unit(np.asarray(embedding.take(take).flatten()).reshape(-1, d))
                forest = known.get(d) or fit(np.zeros((0, d)), *how)
                row, leaf_id = forest.leaves(x, np.asarray(batch.column(4).take(take)))
                order = np.lexsort((leaf_id, row))
                row, leaf_id = row[order], leaf_id[order]
                edges = np.searchsorted(row, np.arange(len(at) + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(leaf_id))
                unit = pa.array([v.tobytes() for v in x], pa.binary())
                known_ = pa.array([leaf_id[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1)), unit, batch.column(3).take(take), lists, known_], names=["node", "label", "unit", "copies", "leaves", "known"])

    kind = dict(copies.dtypes)["label"]
    deep = copies.join(labels.select("label", "depth"), "label").select("node", "label", "embedding", "copies", "depth")
    filed = cut(deep.mapInArrow(file, f"node binary, label {kind}, unit binary, copies long, leaves array<long>, known binary"))
    key = ["label", "leaf", "dim"]
    slight = filed.select("node", "label", F.explode("leaves").alias("leaf"), F.octet_length("unit").alias("dim"))
    tasks = deal(slight, key, "node", slight.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1"), block)
    tasks = tasks.join(filed.select("node", "unit", "copies", "known"), "node")

    def compare(g: dict[str, list]) -> Iterator[dict]:
        own, n = np.array(g["_b"]), len(g["node"])
        i, j, here = g["_i"][0], g["_j"][0], g["leaf"][0]
        x = np.frombuffer(b"".join(g["unit"]), np.float64).reshape(n, -1)
        copies_ = np.array(g["copies"])

        def first_shared(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            """The first leaf of each u that v has too; lists are sorted."""
            some, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            lists = [np.frombuffer(g["known"][k], np.int64) for k in some]
            table = np.full((len(some), max(map(len, lists))), -1, np.int64)
            for k, x_ in enumerate(lists):
                table[k, : len(x_)] = x_
            p_, q_ = table[at[: len(u)]], table[at[len(u) :]]
            both = (p_[:, :, None] == q_[:, None, :]).any(2) & (p_ >= 0)
            return p_[np.arange(len(u)), np.argmax(both, 1)]

        here_only = all(len(b) == 8 for b in g["known"])
        links, tied = np.zeros(n, np.int64), Labels(n)
        lefts = np.flatnonzero(own == i)
        rights = np.flatnonzero(own == j)
        for at in range(0, len(lefts), 512):
            a = lefts[at : at + 512]
            p, q = np.nonzero(x[a] @ x[rights].T >= threshold - 1e-9)
            p, q = a[p], rights[q]
            keep = p < q if i == j else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            for lo in range(0, len(p), 1 << 14):
                u, v = p[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
                exact = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                u, v = u[exact], v[exact]
                if not here_only and len(u):
                    mine = first_shared(u, v) == here
                    u, v = u[mine], v[mine]
                np.add.at(links, u, copies_[v])
                np.add.at(links, v, copies_[u])
                for k in np.unique(u):
                    tied.tie(int(k), v[u == k])
        touched = np.flatnonzero(links)
        if len(touched):
            yield {"node": [g["node"][k] for k in touched], "links": links[touched].tolist(), "root": [g["node"][k] for k in tied.of[touched]]}

    found = cut(grouped(tasks, [*key, "_i", "_j"], compare, "node binary, links long, root binary"))
    return _united(slim, copies, found, "vec_id").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _united(slim: DataFrame, copies: DataFrame, found: DataFrame, id_: str) -> DataFrame:
    """Rows of ``slim(id, node)`` with ``n_links`` and ``component_id``, from
    the nodes' copies and the links that tasks found."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = copies.select("node", "low", "copies").join(links, "node", "left").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes)
    least = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    done = cut(nodes.join(least, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = slim.join(done, "node", "left")
    return out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)), "component_id": F.coalesce("component_id", F.col(id_))})
