"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its word five-grams. In each tree of the forest a set has
a signature of ``DEEP`` MinHash values; sorted, the signatures are a prefix
trie, and two sets meet at the longest prefix that they share in any tree.
Sets that share the shortest prefix, ``SHALLOW`` values, are brought together
and tied to those that seem similar; the number of trees is such that a pair
at the threshold shares that much with the target recall. In each group that
is tied together prefixes are then shortened from full length until they bring
its least similar pairs the target recall. What meets is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .blocks import Labels, deal
from .common import components, cut, grouped, keyed, same_row
from .textbytes import LOWER, MIX, blocks, mixed, prefix, ranges, utf8, words

N = 5
_SLOT = mixed((np.arange(N, dtype=np.uint64) + np.uint64(11)) * MIX) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, edges)``: each text's word five-grams, A-Z folded, repeats
    and all, text d's from ``edges[d]``. A text of one to four words is one
    shorter gram; a text without words has none."""
    start, end, first = words(data, offsets)
    h = ranges(prefix(LOWER[data]), start, end)
    count = np.diff(first)
    grams = np.maximum(count - N + 1, np.minimum(count, 1))
    edges = np.concatenate(([0], np.cumsum(grams)))
    owner = np.repeat(np.arange(len(count)), grams)
    at = first[owner] + np.arange(len(owner)) - edges[owner]
    padded = np.append(h, np.zeros(N, np.uint64))
    out = np.zeros(len(owner), np.uint64)
    for k in range(N):
        out += np.where(at + k < first[owner + 1], padded[at + k], np.uint64(k + 1)) * _SLOT[k]
    return mixed(out), edges


#: Values in a signature, and in the shortest prefix at which sets meet; a
#: value has two bytes, so the latter is one word of 64 bits.
DEEP, SHALLOW = 8, 4


def trees_for(threshold: float, recall: float) -> int:
    """Trees in which a pair at the threshold shares a prefix of ``SHALLOW``
    values somewhere, with probability ``recall`` at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**SHALLOW))) if threshold < 1 else 1


def signatures(h: np.ndarray, edges: np.ndarray, trees: int) -> np.ndarray:
    """``[text, tree, value]``: two bytes of each MinHash value, high byte
    first, so that bytes sort as values do. Texts must have a gram each."""
    out = np.zeros((len(edges) - 1, trees, DEEP), ">u2")
    scratch = np.empty_like(h)
    for t in range(trees):
        for d in range(DEEP):
            odd = mixed(np.array([t * 64 + d + 1], np.uint64) * MIX)[0] | np.uint64(1)
            np.multiply(h, odd, out=scratch)
            out[:, t, d] = mixed(np.minimum.reduceat(scratch, edges[:-1])) >> np.uint64(48)
    return out


def _digest(grams: np.ndarray) -> bytes:
    """128 bits of a sorted set of grams."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def signed(docs: DataFrame, trees: int) -> DataFrame:
    """``(doc_id, th, node, sig)``: ``node`` is a digest of the set of grams,
    ``sig`` the bytes of its signatures; both null where a text has no
    words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for i, j in blocks(offsets):
                h, edges = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.flatnonzero(np.diff(edges) > 0)
                node, sig = [None] * (j - i), [None] * (j - i)
                if len(some):
                    found = signatures(h, np.append(edges[some], edges[-1]), trees)
                    for k, row in zip(some.tolist(), found):
                        node[k], sig[k] = _digest(np.unique(h[edges[k] : edges[k + 1]])), row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "th", "node", "sig"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, node binary, sig binary")


def _sets(rows: DataFrame) -> DataFrame:
    """``rows(node, copies, sig, tasks, text)`` with ``grams`` in place of the
    text: its sorted distinct grams, as bytes of 64-bit numbers."""
    names = ["node", "copies", "sig", "tasks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(4))
            for i, j in blocks(offsets):
                h, edges = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(4)), pa.array(sets, pa.binary())], names=[*names, "grams"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", grams binary")


class Trie:
    """The signatures of a task's sets, for the length of the prefixes that
    pairs share."""

    def __init__(self, sigs: list[bytes]):
        raw = np.frombuffer(b"".join(sigs), ">u2").reshape(len(sigs), -1, DEEP)
        self.values = np.ascontiguousarray(raw.astype(np.uint16))
        words = np.frombuffer(b"".join(sigs), ">u8").reshape(len(sigs), -1, 2).astype(np.uint64)
        self.high, self.low = np.ascontiguousarray(words[:, :, 0]), np.ascontiguousarray(words[:, :, 1])

    def met(self, a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of set ``a`` with each of ``others``: the longest prefix shared, 0
        if it is under ``SHALLOW``, the first tree that shares it, and the
        share of equal values, which estimates the similarity."""
        x = self.low[a] ^ self.low[others]
        length = np.full(x.shape, SHALLOW, np.int8)
        for bits in (48, 32, 16):
            length += x < np.uint64(1 << bits)
        length += x == 0
        length[self.high[a] != self.high[others]] = 0
        longest = length.max(1)
        near = np.zeros(len(others))
        some = np.flatnonzero(longest)
        near[some] = (self.values[a] == self.values[others[some]]).mean((1, 2))
        return longest, length.argmax(1), near


def _meet(threshold: float, spread: float):
    """Finds which sets of a task meet that seem similar. A pair is looked at
    in the first tree of its longest prefix. Returns links, as few as tie
    together what is tied, each to the least set that is tied by then, so that
    other tasks return the same; with each the least similarity, as estimated,
    of the task's pairs."""

    def compare(g: dict[str, list]) -> Iterator[dict]:
        order = sorted(range(len(g["node"])), key=g["node"].__getitem__)
        node, own = [g["node"][k] for k in order], np.array([g["_b"][k] for k in order])
        tree, i, j = g["tree"][0], g["_i"][0], g["_j"][0]
        trie = Trie([g["sig"][k] for k in order])
        rights = np.flatnonzero(own == j)
        labels, out, least = Labels(len(own)), [], 1.0
        for a in np.flatnonzero(own == i):
            others = rights[rights > a] if i == j else rights
            if not len(others):
                continue
            length, first, near = trie.met(a, others)
            keep = np.flatnonzero((length > 0) & (first == tree) & (near >= threshold - 6 * spread))
            if len(keep):
                least = min(least, float(near[keep].min()))
                out += labels.tie(a, others[keep])
        if out:
            yield {"a": [node[x] for x, _ in out], "b": [node[y] for _, y in out], "least": [least] * len(out)}

    return compare


def depth_at(similarity: Column, trees: int, recall: float) -> Column:
    """The longest prefix that a pair of this similarity still shares in some
    tree with probability ``recall``; ``SHALLOW`` where none is that long."""
    out = F.lit(SHALLOW)
    for d in range(SHALLOW + 1, DEEP + 1):
        out = F.when(1 - F.pow(1 - F.pow(similarity, F.lit(d)), F.lit(trees)) >= recall, d).otherwise(out)
    return out


def _verify(threshold: float, spread: float):
    """Compares the two blocks of a task: exact overlaps of the gram sets of
    pairs that meet, in a group of one tree only those whose first tree it
    is."""
    part = Fraction(threshold).limit_denominator(10_000)
    p, q = part.numerator, part.denominator  # overlap / union >= p / q

    def compare(g: dict[str, list]) -> Iterator[dict]:
        # A row equal in id and text to another brings its node twice.
        pick = list({n: k for k, n in enumerate(g["node"])}.values())
        own, copies = (np.array([g[c][k] for k in pick]) for c in ("_b", "copies"))
        node = [g["node"][k] for k in pick]
        sets = [np.frombuffer(g["grams"][k], np.uint64) for k in pick]
        trie = Trie([g["sig"][k] for k in pick])
        i, j, tree, depth = (g[c][0] for c in ("_i", "_j", "tree", "depth"))
        size = np.array([len(s) for s in sets])
        edge = np.concatenate(([0], np.cumsum(size)))
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        rights = np.flatnonzero(own == j)
        mark = np.zeros(ids.max() + 1, np.int32)
        links, labels = np.zeros(len(node), np.int64), Labels(len(node))
        for a in np.flatnonzero(own == i):
            others = rights[rights > a] if i == j else rights
            if not len(others):
                continue
            length, first, near = trie.met(a, others)
            keep = (length >= depth) & (near >= threshold - 6 * spread)
            if tree >= 0:
                keep &= first == tree
            others = others[keep]
            if not len(others):
                continue
            mark[ids[edge[a] : edge[a + 1]]] = 1
            flat = np.concatenate([ids[edge[k] : edge[k + 1]] for k in others])
            both = np.add.reduceat(mark[flat], np.concatenate(([0], np.cumsum(size[others])[:-1])))
            mark[ids[edge[a] : edge[a + 1]]] = 0
            hit = others[both * (p + q) >= p * (size[a] + size[others])]
            links[a] += copies[hit].sum()
            links[hit] += copies[a]
            labels.tie(a, hit)
        touched = np.flatnonzero(links)
        if len(touched):
            yield {"node": [node[k] for k in touched], "links": links[touched].tolist(), "root": [node[k] for k in labels.of[touched]]}

    return compare


def join(docs: DataFrame, **how) -> DataFrame:
    """:func:`classes` without the components."""
    return classes(docs, **how).drop("component")


def classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, block: int = 512, giant: int = 1 << 15) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, th, n_links, class_id,
    component``.

    Two rows are linked where their sets of word five-grams (A-Z folded, white
    space of any kind between words) have a Jaccard similarity of
    ``threshold`` or more; equal sets are. ``n_links`` counts the other rows
    linked directly, ``class_id`` is the least id that links reach. Rows whose
    text is null or has no word link with nothing. Rows may repeat, and count
    as often as they do; a null id is no one's ``class_id`` unless all of the
    class are null. Different classes may have the same ``class_id``, where all
    ids are null or an id repeats; ``component`` tells them apart, null for rows
    without words. ``th`` is the text's digest; other columns do not matter.

    Equal sets are taken together before anything is compared, so copies cost
    nothing. Sets that meet in the forest and whose signatures are not far
    below the threshold make groups; a group is compared in blocks of about
    ``block`` sets, and of its pairs only those that meet. A group of over
    ``giant`` sets, which chains of loose likeness might make, is taken apart
    again by tree and prefix, each pair being the first such tree's."""
    trees = trees_for(threshold, recall)
    spread = math.sqrt(threshold * (1 - threshold) / (trees * DEEP))  # of the estimate from signatures
    slim = cut(signed(docs, trees))
    nodes = cut(
        slim.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    )
    slim = slim.drop("sig")
    width = 2 * DEEP
    starts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("sig"), t * width + 1, F.lit(2 * SHALLOW)))
    filed = nodes.select("node", F.posexplode(starts).alias("tree", "prefix"))
    shared = cut(filed.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where("members > 1"))
    filed = cut(deal(filed, ["tree", "prefix"], "node", shared, block))
    sig = nodes.select("node", "sig")
    met = cut(grouped(filed.join(sig, "node"), ["tree", "prefix", "_i", "_j"], _meet(threshold, spread), "a binary, b binary, least double"))
    groups = cut(components(met.select("a", "b").distinct()).select("node", F.col("component").alias("group")))
    # How far a group's prefixes are shortened follows from the least similar pair in it, however many others there are.
    lows = met.groupBy(F.col("a").alias("node")).agg(F.min("least").alias("least")).join(groups, "node").groupBy("group").agg(F.min("least").alias("least"))
    depths = lows.select("group", depth_at(F.greatest(F.col("least") - 3 * spread, F.lit(threshold)), trees, recall).alias("depth"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    place = cut(groups.join(sizes, "group").join(depths, "group"))
    apart = place.where(F.col("members") > giant).select("node", "group", "depth").join(filed.select("node", "tree", "prefix").distinct(), "node")
    place = place.where(F.col("members") <= giant).select("node", "group", "depth", F.lit(-1).alias("tree"), F.lit(b"").alias("prefix")).union(apart.select("node", "group", "depth", "tree", "prefix"))
    key = ["group", "depth", "tree", "prefix"]
    tasks = deal(place, key, "node", place.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1"), block)
    tasks = tasks.groupBy("node").agg(F.collect_list(F.struct(*key, "_i", "_j", "_b")).alias("tasks"))
    members = cut(nodes.join(tasks, "node").select("node", "copies", "sig", "tasks", F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th")))
    rows = keyed(docs)
    # The same join at every size: one that turns with the members' number
    # would make the shuffle jump.
    sets = _sets(rows.join(members.hint("shuffle_hash"), same_row(rows, members)).select("node", "copies", "sig", "tasks", "text"))
    dealt = sets.select("node", "copies", "sig", "grams", F.inline("tasks"))
    found = cut(grouped(dealt, [*key, "_i", "_j"], _verify(threshold, spread), "node binary, links long, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    done = cut(nodes.select("node", "low", "copies").join(links, "node", "left").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = done.groupBy("component").agg(F.min("low").alias("class_id"))
    done = cut(done.join(least, "component").select("node", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = slim.select("doc_id", "th", "node").join(done, "node", "left")
    return out.select("doc_id", "th", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"), "component")


def distinct(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class that :func:`join` finds: that of
    the least id, once if it repeats. Rows in no class of two all stay; of a
    class of which all ids are null one row stays."""
    found = classes(docs, **how)
    single = found.where("n_links = 0").select("doc_id", "th")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one")
    group = found.where("n_links > 0").groupBy("component").agg(least).select("one.doc_id", "one.th")
    keep = cut(single.withColumn("_one", F.lit(False)).unionByName(group.withColumn("_one", F.lit(True))).distinct())
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_th": th})
    kept = rows.join(keep, (F.col("_th") == keep["th"]) & F.col("_id").eqNullSafe(keep["doc_id"])).select(*[rows[c] for c in rows.columns], "_one")
    single = kept.where("not _one").drop("_id", "_th", "_one")
    return single.unionByName(kept.where("_one").dropDuplicates(["_id", "_th"]).drop("_id", "_th", "_one"))
