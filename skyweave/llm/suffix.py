"""Scoring by a probabilistic suffix tree, beside a unigram baseline.

Symbols are the bytes of a text, A-Z folded and white space run together, and
an end. A context of up to five symbols is a node of the tree if it is common
enough and a divergence test finds that it predicts better than its suffix.
A node's next-symbol counts are smoothed by its suffix's distribution; each
symbol is scored by the longest node that is a suffix of what came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut, keyed
from .textbytes import LOWER, MIX, blocks, prefix, ranges, utf8, words

#: Depth of the tree, and how far its nodes are held as whole distributions.
DEPTH, DENSE, SYMBOLS = 5, 2, 256
# The symbols of the end and of white space. Folding frees the codes of A-Z: bytes 0 and 1 get two of them.
# No UTF-8 text has byte 255; its code stands for what a node leaves to its suffix.
END, GAP, REST = 0, 1, 255
SYMBOL = LOWER.copy()
SYMBOL[[0, 1]] = (65, 66)
USED = np.setdiff1d(np.concatenate(([END, GAP], SYMBOL)), [9, 10, 11, 12, 13, 32, REST])
#: Occurrences that a node has at least.
LEAST = 10
#: The end's digest among those of words; words have others.
END_WORD = np.uint64(0)


class Sums:
    """Counts by key, gathered block by block and merged now and then."""

    def __init__(self, limit: int):
        self.parts, self.held, self.limit = [], 0, limit

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def full(self) -> bool:
        return self.held > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        self.parts, self.held = [], 0
        if not len(keys):
            return keys, counts
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[start], np.add.reduceat(counts, start)


def _summed(docs: DataFrame, count, kind: pa.DataType, limit: int = 2_000_000) -> DataFrame:
    """``(kind, key, n)``: what ``count(bytes, offsets)`` yields for the blocks
    of ``docs(…, text)``, summed in the tasks and then over them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Sums] = {}

        def out(k: int) -> pa.RecordBatch:
            keys, n = sums[k].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64) if keys.dtype != np.uint64 else keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for i, j in blocks(offsets):
                for k, keys, n in count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    mine = sums.setdefault(k, Sums(limit))
                    mine.add(keys, n)
                    if mine.full():
                        merged = mine.take()
                        mine.add(*merged)
                        if mine.held > limit // 2:
                            yield out(k)
        for k in sums:
            if sums[k].parts:
                yield out(k)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(data, offsets)
    return ranges(prefix(LOWER[data]), start, end), first


def count_words(data: np.ndarray, offsets: np.ndarray):
    h, _ = word_hashes(data, offsets)
    yield 0, *np.unique(np.append(h, np.repeat(END_WORD, len(offsets) - 1)), return_counts=True)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, edges)``: each text's symbols after ``DEPTH`` ends and
    before one; text d's start at ``edges[d]``."""
    start, end, first = words(data, offsets)
    keep = np.zeros(len(data) + 1, np.int64)
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    keep = np.cumsum(keep)[:-1] > 0
    out = SYMBOL[data]
    heads = np.zeros(len(start) + 1, bool)
    heads[first[:-1]] = True
    gaps = start[~heads[:-1]] - 1  # the white space before every word but a text's first
    keep[gaps] = True
    out[gaps] = GAP
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    size = np.diff(kept)
    edges = np.concatenate(([0], np.cumsum(size + DEPTH + 1)))
    flat = np.full(edges[-1], END, np.uint8)
    at = np.flatnonzero(keep)
    owner = np.repeat(np.arange(len(size)), size)
    flat[np.arange(len(at)) - kept[owner] + kept[0] + edges[owner] + DEPTH] = out[at]
    return flat, edges


def contexts(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(context, symbol, first)``: every symbol to be predicted, in order,
    with the code of the ``DEPTH`` symbols before it."""
    s = flat.astype(np.int64)
    n = len(s) - DEPTH
    code = np.zeros(max(n, 0), np.int64)
    for k in range(DEPTH):
        code = code * SYMBOLS + s[k : k + n]
    ahead = np.ones(len(s), bool)
    for k in range(DEPTH):
        ahead[edges[:-1] + k] = False
    keep = np.flatnonzero(ahead[DEPTH:])
    first = edges[:-1] - DEPTH * np.arange(len(edges) - 1)
    return code[keep], s[DEPTH:][keep], first


def count_contexts(data: np.ndarray, offsets: np.ndarray):
    code, symbol, _ = contexts(*symbols(data, offsets))
    yield 0, *np.unique(code * SYMBOLS + symbol, return_counts=True)


def key_of(depth: int, code: np.ndarray, symbol: np.ndarray | int) -> np.ndarray:
    """One number for a symbol after a context of ``depth`` symbols."""
    return np.int64(depth) << np.int64(56) | code << np.int64(8) | symbol


@dataclass(frozen=True)
class Tree:
    """``base``: log10 shares of the symbols; ``codes[d]``, ``logs[d]``: the
    nodes of one and two symbols and their distributions; ``keys``,
    ``values``: of longer nodes the log10 probabilities of the symbols that
    were seen, and for ``REST`` the factor that the suffix's probability takes
    for all others. ``words``: digests and counts of the words that are
    frequent; ``total``, ``distinct``: the training tokens."""

    base: np.ndarray
    codes: dict
    logs: dict
    keys: np.ndarray
    values: np.ndarray
    words: tuple
    total: int
    distinct: int

    def scorer(self):
        """A function from codes of full-length contexts and symbols to log10
        probabilities. Keys are looked up by slots of a hash, in whose order
        they stand."""
        dense = np.tile(self.base, (SYMBOLS, 1))
        dense[self.codes[1]] = self.logs[1]
        dense = np.tile(dense, (SYMBOLS, 1))
        dense[self.codes[2]] = self.logs[2]
        keys, values, bits = self.keys, self.values, self.bits(len(self.keys))
        start = np.zeros((1 << bits) + 1, np.int32)
        for k in range(0, len(keys), 1 << 20):
            np.add.at(start, self.slots(keys[k : k + (1 << 20)], bits) + 1, 1)
        np.cumsum(start, out=start)

        def look(key: np.ndarray) -> np.ndarray:
            """Places in ``values``, or -1."""
            s = self.slots(key, bits)
            at, end = start[s], start[s + 1]
            out = np.full(len(key), -1, np.int32)
            open_ = np.flatnonzero(at < end)
            while len(open_):
                hit = keys[at[open_]] == key[open_]
                out[open_[hit]] = at[open_[hit]]
                open_ = open_[~hit]
                at[open_] += 1
                open_ = open_[at[open_] < end[open_]]
            return out

        def score(code: np.ndarray, symbol: np.ndarray) -> np.ndarray:
            out = np.zeros(len(code))
            left = np.arange(len(code))
            for d in range(DEPTH, DENSE, -1):
                c = code[left] & ((1 << 8 * d) - 1)
                at = look(key_of(d, c, symbol[left]))
                hit = at >= 0
                out[left[hit]] += values[at[hit]]
                left, c = left[~hit], c[~hit]
                at = look(key_of(d, c, REST))
                some = at >= 0
                out[left[some]] += values[at[some]]
            out[left] += dense[code[left] & (SYMBOLS**DENSE - 1), symbol[left]]
            return out

        return score

    @staticmethod
    def bits(count: int) -> int:
        return max(4, count.bit_length())

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


#: Symbols by which longer nodes are dealt to blocks: a node's suffixes down to that length share its block.
SHARED = DENSE + 1


def block_of(code, blocks: int):
    """The block of the nodes that end in the last ``SHARED`` symbols of
    ``code``, an array or a column."""
    return (code % SYMBOLS**SHARED) * 2654435761 % 4294967296 % blocks


@dataclass(frozen=True)
class Nodes:
    """The tree's nodes, in Spark: counts by length of context, and which are
    kept. ``blocks``: how many parts they are held in, each with at most about
    ``bound`` numbers; a part has all nodes that its contexts can meet."""

    levels: list
    keeps: dict
    pull: float
    blocks: int
    words: tuple
    total: int
    distinct: int

    def _kept(self, d: int, block: int | None) -> DataFrame:
        keep = self.keeps[d].select("c")
        return self.levels[d].join(keep if block is None or self.blocks == 1 else keep.where(block_of(F.col("c"), self.blocks) == block), "c")

    def tree(self, block: int = 0) -> Tree:
        """One part, at hand. Smoothing adds ``pull`` pseudo-counts of the
        suffix's distribution."""
        pull = self.pull
        found = self.levels[0].toArrow()
        base = np.zeros(SYMBOLS)
        base[USED] = 1
        base[found["s"].to_numpy()] += found["n"].to_numpy()
        base = (base / base.sum()).astype(np.float32)
        nodes, rows, keys, values = {}, {0: base[None, :]}, [], []
        for d in range(1, DEPTH + 1):
            found = self._kept(d, block if d > DENSE else None).toArrow()
            c, s, m = (found[x].to_numpy() for x in ("c", "s", "n"))
            codes, at = np.unique(c, return_inverse=True)
            size = np.bincount(at, m, len(codes)) + pull
            if d <= DENSE:
                table = np.zeros((len(codes), SYMBOLS), np.float32)
                table[at, s] = m
                above = rows[d - 1][np.searchsorted(nodes[d - 1], codes % SYMBOLS ** (d - 1))] if d > 1 else rows[0]
                nodes[d], rows[d] = codes, ((table + np.float32(pull) * above) / size[:, None]).astype(np.float32)
                continue
            parent = c % SYMBOLS ** (d - 1)
            if d == DENSE + 1:
                above = rows[DENSE][np.searchsorted(nodes[DENSE], parent), s] if len(c) else np.zeros(0)
            else:  # what was seen after a context was seen after its suffix
                above = share[np.searchsorted(own, key_of(d - 1, parent, s.astype(np.int64)))] if len(c) else np.zeros(0)
            own, share = key_of(d, c, s.astype(np.int64)), (m + pull * above) / size[at]
            order = np.argsort(own)
            own, share = own[order], share[order]
            keys += [own, key_of(d, codes, REST)]
            values += [share, pull / size]
        with np.errstate(divide="ignore"):  # symbols that do not occur
            base_, logs = np.log10(base), {d: np.log10(rows[d]) for d in (1, 2)}
            keys, values = np.concatenate(keys), np.log10(np.concatenate(values)).astype(np.float32)
        order = np.argsort(Tree.slots(keys, Tree.bits(len(keys))), kind="stable")
        return Tree(base_, nodes, logs, keys[order], values[order], self.words, self.total, self.distinct)


def grow(counts: DataFrame, least: int, gain: float, bound: int) -> tuple[list, dict, int]:
    """``levels``, ``keeps`` and ``blocks`` of :class:`Nodes` from
    ``counts(key, n)`` of contexts with their symbol.

    A context is kept that occurs ``least`` times and whose distribution
    diverges from its suffix's: the counts' log-likelihood under its own is
    ``gain`` nats or more above that under the suffix's. So are all suffixes of
    one that is kept. None of this depends on the size of the corpus or on
    ``bound``: what is kept of some texts is kept of more."""
    n = F.col("n")
    levels = [cut(counts.select((F.floor(F.col("key") / SYMBOLS) % SYMBOLS**d).cast("long").alias("c"), (F.col("key") % SYMBOLS).cast("int").alias("s"), "n").groupBy("c", "s").agg(F.sum(n).alias("n"))) for d in range(DEPTH, -1, -1)][::-1]
    totals = [x.groupBy("c").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")) for x in levels]
    kept, keeps, size = None, {}, 0
    for d in range(DEPTH, 0, -1):
        up = levels[d - 1].join(totals[d - 1], "c").select(F.col("c").alias("p"), "s", (n / F.col("all")).alias("q"))
        mine = levels[d].join(totals[d].where(F.col("all") >= least), "c").withColumn("p", F.col("c") % SYMBOLS ** (d - 1))
        won = mine.join(up, ["p", "s"]).groupBy("c").agg(F.sum(n * F.log(n / F.col("all") / F.col("q"))).alias("gain")).where(F.col("gain") >= gain).select("c")
        kept = won if kept is None else won.union(kept.select((F.col("c") % SYMBOLS**d).alias("c"))).distinct()
        keeps[d] = kept = cut(kept.join(totals[d], "c").select("c", "kinds"))
        if d > DENSE:
            size += kept.agg(F.coalesce(F.sum(F.col("kinds") + 1), F.lit(0))).first()[0]
        kept = kept.select("c")
    return levels, keeps, max(1, -(-size // bound))


def learn(docs: DataFrame, gain: float = 10.0, pull: float = 6.0, frequent: int = 1 << 21, least: int = LEAST, bound: int = 1 << 24) -> tuple[Nodes, DataFrame]:
    """The tree of all ``docs(text)``, and ``(h, c)``, the count of every word
    by digest. Words that make up at least one in ``frequent`` tokens, at most
    that many, are at hand in the tasks that score; the others are joined.

    A node occurs ``least`` times, whatever the size of the corpus, so the
    tree grows with it. ``bound`` is what a task holds of it at a time, in
    numbers of twenty bytes with their slots; a tree with more is scored part
    by part, and gives the same. A null text is empty."""
    text = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    tokens = cut(_summed(text, count_words, pa.int64())).select(F.col("key").alias("h"), F.col("n").alias("c"))
    size = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"], size["v"]
    common = tokens.where(F.col("c") * frequent >= total).toArrow()
    h, c = common["h"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(h)
    codes = cut(_summed(text, count_contexts, pa.int64()).select("key", "n"))
    levels, keeps, blocks_ = grow(codes, least, gain, bound)
    return Nodes(levels, keeps, pull, blocks_, (h[order], c[order]), total, distinct), tokens


_ready: dict = {}

ROWS = "doc_id long, th long, kind int, h long, tf long, n_tokens long, n_known long, base double, score double"


def _scorer(shared, key: str, block: int, count: int):
    """Rows of kind 0, one a text, with what the tree and the frequent words
    give; of kind 1, the other words of each text. Where the tree has several
    parts, the first gives these with its share of the score, and the others
    their shares in rows of kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        if key not in _ready:
            _ready.clear()
            _ready[key] = tree.scorer()
        points = _ready[key]
        known, counts = tree.words
        logs = np.log10(counts + 1.0)
        names = [f.split()[0] for f in ROWS.split(", ")]
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for i, j in blocks(offsets):
                part, inner = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                code, symbol, first = contexts(*symbols(part, inner))
                if count == 1:
                    each = points(code, symbol)
                else:
                    each, mine = np.zeros(len(code)), block_of(code, count) == block
                    each[mine] = points(code[mine], symbol[mine])
                score = np.add.reduceat(each, first)
                if block:
                    ids, th, none = batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.zeros(j - i, np.int64))
                    yield pa.RecordBatch.from_arrays([ids, th, pa.array(np.full(j - i, 2, np.int32)), th, none, none, none, pa.array(np.zeros(j - i)), pa.array(score)], names=names)
                    continue
                h, at = word_hashes(part, inner)
                n = np.diff(at)
                # The end of each text is a token among the others.
                owner = np.concatenate((np.repeat(np.arange(j - i), n), np.arange(j - i)))
                h = np.concatenate((h, np.repeat(END_WORD, j - i)))
                place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                seen = np.bincount(owner[hit], minlength=j - i)
                base = np.bincount(owner[hit], logs[place[hit]] if len(known) else None, j - i)
                rare, of = h[~hit], owner[~hit]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                start = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])))) if len(rare) else np.zeros(0, np.int64)
                tf = np.diff(np.append(start, len(rare)))
                ids, th = batch.column(0)[i:j], batch.column(1)[i:j]
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(np.zeros(j - i, np.int32)), th, pa.array(np.ones(j - i, np.int64)), pa.array(n + 1), pa.array(seen), pa.array(base.astype(float)), pa.array(score)], names=names)
                take, some = pa.array(of[start]), len(start)
                zero, none = pa.array(np.zeros(some, np.int64)), pa.array(np.zeros(some))
                yield pa.RecordBatch.from_arrays([ids.take(take), th.take(take), pa.array(np.ones(some, np.int32)), pa.array(rare[start].view(np.int64)), pa.array(tf), zero, zero, none, none], names=names)

    return run


def score(docs: DataFrame, tree: Nodes, tokens: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, n_known,
    train_tokens, base_score, score``.

    ``score`` is the log10 probability of the whole text under the tree, its
    end included; ``base_score`` that of its tokens, words and one end, by
    add-one smoothed counts. Counts of frequent words are at hand in the
    tasks; the rest of a text's words are joined to ``tokens`` by digest. Null
    texts are empty and have their end alone; rows may repeat, ids be null;
    other columns do not matter. White space is scored as the tree has it: run
    together, and none at either end.

    A tree of several parts takes one pass over the texts each, one after the
    other: a symbol is scored in the pass of the part that its context ends
    in."""
    spark = docs.sparkSession
    ship(spark)
    rows = None
    for k in range(tree.blocks):
        shared = spark.sparkContext.broadcast(tree.tree(k))  # bounded by the numbers of frequent words and nodes of a part
        part = keyed(docs).mapInArrow(_scorer(shared, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", k, tree.blocks), ROWS)
        if tree.blocks > 1:
            part = cut(part)
            shared.unpersist()
        rows = part if rows is None else rows.unionByName(part)
    found = rows.join(tokens.select(F.lit(1).alias("kind"), "h", "c"), ["kind", "h"], "left")
    word = F.col("kind") == 1
    c = F.coalesce("c", F.lit(0))
    per = found.groupBy("doc_id", "th").agg(
        F.count_if(F.col("kind") == 0).cast("int").alias("m"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(word & (c > 0), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(word, F.col("tf") * F.log10(c + 1.0)).otherwise(0.0)).alias("base"),
        F.sum("score").alias("score"),
    )
    n = (F.col("n_tokens") / F.col("m")).cast("long")
    whole = F.log10(F.lit(float(tree.total + tree.distinct + 1)))
    return per.select(
        "doc_id",
        n.alias("n_tokens"),
        (F.col("n_known") / F.col("m")).cast("long").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("m") - n * whole).alias("base_score"),
        (F.col("score") / F.col("m")).alias("score"),
        F.explode(F.sequence(F.lit(1), "m")).alias("_copy"),
    ).drop("_copy")
