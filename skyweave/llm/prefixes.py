"""Prefix tries of conversations, held as tables of nodes.

A node is a sequence of turns that some conversation begins with. Its digest
is the exclusive or of its turns' digests, each salted with its place, so that
prefixes of one conversation follow from sums over its rows, however many it
has. Sums over subtrees are made in shards of whole stretches of
conversations: a shard gives each of its distinct digests a slot by a minimal
perfect hash, scatters what its conversations bring into flat arrays, and
passes it on through the array of parents' slots, deepest first. A node that
is common to many shards is summed over them afterwards, so no node, however
popular, and no conversation, however long, is one task's affair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut
from .textbytes import MIX, mixed

#: Turns of a conversation that stay together, low bits of the ids of those that
#: lie together in a shard, and rows of a shard, about.
BAND, NEAR, SHARD = 4096, 6, 100_000
#: Low bits of the ids that are joined into one string before they are hashed.
RUN = 12
_WORD = r"[^\x20\x09-\x0D]+"
_NODE, _PARENT = ["n1", "n2"], ["p1", "p2"]


class Slots:
    """A minimal perfect hash of distinct 128-bit keys, given as two arrays.

    On each level keys are hashed to twice as many places as there are keys;
    those alone in their place stay, the others go a level down. A key's slot
    is the rank of its place. The keys themselves stand in their slots, so a
    key that has none is told from one that has."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.ranks, base = len(a), [], 0
        left = np.arange(len(a))
        while len(left):
            place = self._place(a[left], b[left], len(self.ranks), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            rank = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.ranks.append(rank)
            base += int(alone.sum())
            left = left[~alone[place]]
        self.a, self.b = np.zeros(self.n, a.dtype), np.zeros(self.n, b.dtype)
        slot = self._find(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mixed(np.array([level + 1], np.uint64) * MIX)[0]
        return (mixed((a ^ salt) * MIX + b) % np.uint64(size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, rank in enumerate(self.ranks):
            if not len(left):
                break
            slot[left] = rank[self._place(a[left], b[left], level, len(rank))]
            left = left[slot[left] < 0]
        return slot

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that are not in the table."""
        slot = self._find(a, b)
        if not self.n:
            return slot
        good = (slot >= 0) & (self.a[slot] == a) & (self.b[slot] == b)
        return np.where(good, slot, -1)


def ordered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, part, at, turn, words)`` of a table ``(conv_id, turn, role,
    text)``: ``turn`` is a digest of role and text, ``at`` grows along each
    conversation, and ``part`` is the stretch of the whole table that a row is
    in. Turns come by number, null first; rows of equal number by digest. A
    null role or text is empty; rows without a conversation are left out.
    Written, as places are told by where a row was written."""
    part = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    role, text = part("role"), part("text")
    slim = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("number"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    key = ["conv_id", F.asc_nulls_first("number"), "turn"]
    dealt = cut(slim.withColumn("turn", F.unhex("turn"))).repartitionByRange(*key).sortWithinPartitions(*key)
    return cut(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "turn", "words"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of :func:`ordered` with ``pos``, from 1 on, and the table of
    conversations ``(conv_id, length)``. A conversation's stretches are
    counted, not its rows: they are as few as the parts it lies in."""
    runs = cut(rows.groupBy("conv_id", "part").agg(F.min("at").alias("_from"), F.count("*").alias("_rows")))
    before = F.sum("_rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    found = rows.join(starts, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("_from") + F.col("_before") + 1)
    return found.select("conv_id", "pos", "turn", "words"), runs.groupBy("conv_id").agg(F.sum("_rows").alias("length"))


def forked(rows: DataFrame, lengths: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation ``c`` begun with the first ``crc32(c) % most`` turns
    of conversation ``c - c % block`` in place of its own: ``(conv_id, pos,
    turn, words)`` and ``(conv_id, length)``. What that conversation does not
    have is left out, what follows moves up."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    c = F.col("conv_id")
    every = lengths.select("conv_id", "length", (c - c % block).alias("_root"), head(c).alias("_head"))
    roots = lengths.select(c.alias("_root"), F.col("length").alias("_there"))
    plan = cut(
        every.join(roots, "_root", "left")
        .withColumn("_lead", F.least("_head", F.coalesce("_there", F.lit(0))))
        .select("conv_id", "_root", "_head", "_lead", (F.col("_lead") + F.greatest(F.col("length") - F.col("_head"), F.lit(0))).alias("length"))
    )
    moved = plan.where("_lead < _head").select("conv_id", (F.col("_head") - F.col("_lead")).alias("_up"))
    own = rows.where(F.col("pos") > head(c)).join(moved, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("_up", F.lit(0))).alias("pos"), "turn", "words")
    heads = rows.where((c % block == 0) & (F.col("pos") < most)).select(c.alias("_root"), "pos", "turn", "words")
    lead = plan.where("_lead > 0").join(heads, "_root").where("pos <= _lead").select("conv_id", "pos", "turn", "words")
    return own.unionByName(lead), plan.select("conv_id", "length")


def paths(rows: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """``(conv_id, band, depth, n1, n2, p1, p2, words, last)``: the node that
    each row of ``(conv_id, pos, turn, words)`` leads to and its parent, as
    two numbers each; the root is 0, 0. ``last`` marks the end of one of
    ``lengths``. A conversation is dealt out in bands of depth; what the bands
    before sum up to is joined to the few rows of long ones."""
    term = lambda k: F.xxhash64(F.lit(k), "pos", "turn")
    own = rows.select("conv_id", F.floor((F.col("pos") - 1) / band).alias("band"), F.col("pos").alias("depth"), term(1).alias("t1"), term(2).alias("t2"), "words")
    ends = lengths.where("length > 0").select("conv_id", F.floor((F.col("length") - 1) / band).alias("band"), F.col("length").alias("_end"))
    if band_count(lengths, band) > 1:
        own = cut(own)
        sums = own.join(lengths.where(F.col("length") > band).select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "band").agg(F.bit_xor("t1").alias("_s1"), F.bit_xor("t2").alias("_s2"))
        before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select("conv_id", "band", *[F.coalesce(F.bit_xor(f"_s{k}").over(before), F.lit(0)).alias(f"_c{k}") for k in (1, 2)])
        own = own.join(carry, ["conv_id", "band"], "left")
    else:
        own = own.withColumns({"_c1": F.lit(None).cast("long"), "_c2": F.lit(None).cast("long")})
    order = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    node = [F.bit_xor(f"t{k}").over(order).bitwiseXOR(F.coalesce(f"_c{k}", F.lit(0))).alias(f"n{k}") for k in (1, 2)]
    found = own.join(ends, ["conv_id", "band"], "left").select("conv_id", "band", "depth", *node, "t1", "t2", "words", F.coalesce(F.col("depth") == F.col("_end"), F.lit(False)).alias("last"))
    return found.select("conv_id", "band", "depth", *_NODE, *[F.col(f"n{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)], "words", "last")


def band_count(lengths: DataFrame, band: int) -> int:
    longest = lengths.agg(F.max("length")).first()[0] or 0
    return -(-longest // band)


def _array(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])


def _accumulated(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One shard: sums over the subtrees of its nodes, of what its rows bring
    themselves (leaves, saved, the node as its parent's child) and of what
    their conversations bring further down (``more_*``)."""
    n1, n2, p1, p2 = (_array(rows, c).view(np.uint64) for c in (*_NODE, *_PARENT))
    depth, band = _array(rows, "depth"), _array(rows, "band")
    keys = np.zeros((2 * len(n1), 2), np.uint64)
    keys[:, 0], keys[:, 1] = np.concatenate((n1, p1)), np.concatenate((n2, p2))
    kinds, first = np.unique(np.ascontiguousarray(keys).view("V16").ravel(), return_index=True)
    table = Slots(keys[first, 0], keys[first, 1])
    at, up = table(n1, n2), table(p1, p2)
    if (at < 0).any() or (up < 0).any():
        raise RuntimeError("a digest has no slot")
    deep, parent, gate = np.zeros(table.n, np.int64), np.full(table.n, -1, np.int64), np.ones(table.n, bool)
    deep[up], gate[at] = depth - 1, False
    deep[at], parent[at] = depth, up
    if (deep[at] != depth).any() or (parent[at] != up).any() or (deep[up] != depth - 1).any():
        raise RuntimeError("two nodes have one digest")
    kids, sums = np.zeros(table.n, np.int64), np.zeros((table.n, 2), np.int64)
    np.add.at(kids, up, _array(rows, "own").astype(np.int64))
    for k, name in enumerate(("leaves", "saved")):
        np.add.at(sums[:, k], at, _array(rows, name) + _array(rows, f"more_{name}"))
    # What is above a band hears of it by its conversations, the root alone directly.
    order = np.flatnonzero(~gate)
    order = order[np.argsort(-deep[order], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
        np.add.at(sums, parent[level], sums[level])
    sums[gate & (deep > 0)] = 0
    some = np.flatnonzero((kids > 0) | (sums != 0).any(1))
    columns = [table.a[some].view(np.int64), table.b[some].view(np.int64), kids[some], sums[some, 0], sums[some, 1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_NODE, "n_children", "n_leaves", "saved_tokens"])


def _subtrees(rows: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and shard[a] != last:
                    yield _accumulated(held)
                    held = []
                last = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _accumulated(held)

    ship(rows.sparkSession)
    # A shard has one band: were a node there with those below it in the next, it would hear of them twice.
    dealt = rows.withColumn("shard", F.col("band") * shards + F.pmod(F.xxhash64(F.shiftright("conv_id", NEAR)), F.lit(shards)))
    part = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "n1 long, n2 long, n_children long, n_leaves long, saved_tokens long")
    return part.groupBy(*_NODE).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])


def _digests(ends: DataFrame) -> DataFrame:
    """``(n1, n2, ends_sha256)`` of ``(n1, n2, conv_id)``. Ids are first
    joined in runs of neighbours; a node's runs pass through a hash one after
    the other."""
    run_of = F.shiftright("conv_id", RUN)
    runs = ends.groupBy(*_NODE, run_of.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) == last:
                    digest.update(b",")
                else:
                    if last:
                        done.append((*last, digest.hexdigest()))
                    last, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            yield _rows(done)
        if last:
            yield _rows([(*last, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=[*_NODE, "ends_sha256"])

    ship(ends.sparkSession)
    return runs.repartition(*_NODE).sortWithinPartitions(*_NODE, "run").mapInArrow(hashed, "n1 long, n2 long, ends_sha256 string")


def nodes(rows: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of sequences ``rows(conv_id, pos, turn, words)``, ``turn``
    being what tells turns apart, and ``lengths(conv_id, length)``, which may
    have sequences without a row: one row a node, ``n1, n2`` (its digest),
    ``conv_id`` (its least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over its subtree, words of
    the last turn for each member beyond the first) and ``ends_sha256`` (of the
    ids of members that end there, in order, comma-joined).

    No sequences give no rows, not even a root; equal sequences are members of
    the same nodes."""
    steps = cut(paths(rows, lengths, band))
    found = cut(
        steps.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("_ends"),
            *[F.min(c).alias(c) for c in ("depth", "words", *_PARENT)],
        )
    )
    # Each node's own share is brought by its least member; the key is that of steps, so no node is crowded.
    shares = found.select(
        "conv_id", "depth", F.lit(True).alias("own"), (F.col("_ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    brought = steps.join(shares, ["conv_id", "depth"], "left").withColumns({"own": F.coalesce("own", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in ("leaves", "saved")}})
    more = {f"more_{c}": F.lit(0).cast("long") for c in ("leaves", "saved")}
    if band_count(lengths, band) > 1:
        long = lengths.where(F.col("length") > band).select("conv_id")
        sums = brought.join(long, "conv_id", "left_semi").groupBy("conv_id", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
        later = sums.select("conv_id", ((F.col("band") + 1) * band).alias("depth"), *[F.sum(c).over(below).alias(f"_{c}") for c in ("leaves", "saved")])
        brought = brought.join(later, ["conv_id", "depth"], "left")
        more = {f"more_{c}": F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")}
    brought = brought.withColumns(more).select("conv_id", "band", "depth", *_NODE, *_PARENT, "own", "leaves", "saved", *more)
    whole = steps.count()  # from the written table's footers
    sums = _subtrees(brought, max(1, -(-whole // SHARD)))
    root = [F.lit(0).cast("long").alias(c) for c in _NODE]
    ends = _digests(steps.where("last").select(*_NODE, "conv_id").unionByName(lengths.where("length = 0").select(*root, "conv_id")))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("_ends")).where("n_convs > 0")
    top = top.select(*root, "conv_id", "n_convs", "_ends", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(c) for c in _PARENT])
    every = found.unionByName(top)
    parents = found.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("_parent"))
    least = F.broadcast(top.select(F.col("conv_id").alias("_least")))  # one row
    out = every.join(sums, _NODE, "left").join(ends, _NODE, "left").join(parents, _PARENT, "left").join(least, how="left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *_NODE, "conv_id", "depth", F.when(F.col("depth") == 1, F.col("_least")).otherwise(F.col("_parent")).alias("parent_conv_id"), "n_convs", none("n_children"),
        # A root that all end at is a leaf; no row tells.
        F.when((F.col("depth") == 0) & (F.col("_ends") == F.col("n_convs")), 1).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        none("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, block: int | None = None, most: int = 4, band: int = BAND) -> DataFrame:
    """:func:`nodes` of a table ``(conv_id, turn, role, text)``, of which
    :func:`ordered` says how odd rows count. With ``block``, conversations are
    :func:`forked` first. Other columns do not matter."""
    rows, lengths = placed(ordered(conversations))
    lengths = cut(lengths)
    if block:
        rows, lengths = forked(rows, lengths, block, most)
    return nodes(rows, lengths, band)


#: crc32 of a number's digits, which DuckDB has no function for.
_CRC = """xor(CAST(4294967295 AS UBIGINT), list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(l.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda u, v: xor(u >> 1, CAST(3988292384 AS UBIGINT) * (u & 1)))))"""

#: The same in DuckDB: nodes as lists of turns, subtrees by the paths of their nodes' least members.
SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, count(*) AS length FROM turns GROUP BY 1),
plan AS (SELECT l.conv_id, l.conv_id - l.conv_id % 20 AS root, CAST({_CRC} % 4 AS BIGINT) AS head, l.length FROM lengths l),
led AS (SELECT p.*, least(p.head, coalesce(r.length, 0)) AS lead FROM plan p LEFT JOIN lengths r ON r.conv_id = p.root),
ends AS (SELECT conv_id, lead + greatest(length - head, 0) AS length FROM led),
steps AS (
  SELECT p.conv_id, t.pos AS depth, t.turn, t.words FROM led p JOIN turns t ON t.conv_id = p.root AND t.pos <= p.lead
  UNION ALL SELECT p.conv_id, t.pos - p.head + p.lead, t.turn, t.words FROM led p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.head),
paths AS MATERIALIZED (SELECT conv_id, depth, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM ends),
found AS MATERIALIZED (
  SELECT node, any_value(depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, count(*) FILTER (depth = length) AS n_ends,
    string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = length) AS ids
  FROM paths p JOIN ends USING (conv_id) GROUP BY node),
sums AS (
  SELECT p.node, count(*) FILTER (f.n_ends = f.n_convs) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens, count(*) FILTER (f.depth = p.depth + 1) AS n_children
  FROM found f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM found f JOIN sums s USING (node) LEFT JOIN found u ON f.depth > 0 AND u.node = left(f.node, length(f.node) - 32)"""
