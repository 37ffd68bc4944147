"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes decides where a chunk ends, so an
insertion moves the cuts near it and no others. Chunks are compared by digest;
of those that occur more than once, all but the first are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut, keyed
from .textbytes import MIX, blocks, mixed, utf8

GEAR = (mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MIX) >> np.uint64(32)).astype(np.uint32)
REACH = 32


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of ``GEAR[b] << k`` over the last
    32 bytes, k counting back. Sums over 1, 2, 4 … bytes double up to it."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Ends of all chunks: where the hash's upper ``bits`` are zero, every
    ``most`` bytes where they are not, and at the ends of texts. Near the
    start of a text, where the hash would reach into the one before, none."""
    at = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    start = offsets[np.searchsorted(offsets, at - 1, "right") - 1]
    ends = np.union1d(at[at - start >= REACH], offsets[1:][np.diff(offsets) > 0])
    gaps = np.diff(ends, prepend=offsets[0])
    long = np.flatnonzero(gaps > most)
    if len(long):
        more = [np.arange(ends[i] - gaps[i] + most, ends[i], most) for i in long]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


CHUNK = "doc_id long, th long, start long, size long, d1 long, d2 long"


def chunked(docs: DataFrame, bits: int = 5, least: int = 12, most: int = 256) -> DataFrame:
    """The chunks of at least ``least`` bytes of every whole text, with their
    place in bytes and 128-bit digest. Shorter ones are often equal by chance;
    they still are cuts."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            ids, th = batch.column(0), batch.column(1)
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                inner = offsets[i : j + 1] - offsets[i]
                if not len(part):
                    continue
                ends = cuts(part, inner, bits, most)
                starts = np.concatenate(([0], ends[:-1]))
                fit = ends - starts >= least
                starts, ends = starts[fit], ends[fit]
                raw = part.tobytes()
                digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
                d = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
                owner = np.searchsorted(inner, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner + i)), th.take(pa.array(owner + i)), pa.array(starts - inner[owner]), pa.array(ends - starts), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    names=["doc_id", "th", "start", "size", "d1", "d2"],
                )

    return keyed(docs).mapInArrow(run, CHUNK)


def repeats(docs: DataFrame, **how) -> DataFrame:
    """Every chunk that occurs more than once, ``(doc_id, th, start, size,
    first)``; ``first`` marks the occurrence of the lowest id, then text digest,
    then place.

    A count by half of the digest, combined before the shuffle, sorts out the
    many chunks that occur once; only the others are shuffled with their
    place. The chunks are cut twice rather than kept."""
    seen = cut(chunked(docs, **how).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"))
    again = cut(chunked(docs, **how).join(seen, "d1", "left_semi"))
    firsts = cut(again.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("low")).where("n > 1").drop("n"))
    place = F.struct("doc_id", "th", "start")
    return again.join(firsts, ["d1", "d2"]).select("doc_id", "th", "start", "size", (F.to_json(place) == F.to_json("low")).alias("first"))


def deduplicate(docs: DataFrame, run: int = 160, anchor: int = 24, gap: int = 24, **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_repeated,
    n_removed, spans, n_equal, n_again``.

    ``n_equal`` counts the bytes of all chunks that occur more than once, runs
    or not, and ``n_again`` those of all their occurrences but the first of
    the whole table. The other columns are about passages. A passage is a run of repeated chunks, gaps of under ``gap`` bytes
    included, of at least ``run`` bytes, one chunk of which has ``anchor`` bytes
    or more: neither a line or two nor short chunks that are equal by chance
    make a passage. On 10,000 documents that finds 97 in 100 with a passage of
    51 words that repeats, and 2 to 3 in 100 of the others, which share less.
    ``n_repeated`` counts the bytes of its chunks, which all occur
    elsewhere too, ``n_removed`` those that go: of each chunk, all occurrences
    but the first of the whole table. ``spans`` lists the latter as start:end
    in bytes, ends exclusive, joined by commas. Null texts are empty. Rows
    equal in id and text share one first occurrence and get equal results.
    Other columns do not matter."""
    row = ["doc_id", "th"]
    order = Window.partitionBy(*row).orderBy("start")
    again = F.when(F.col("first"), 0).otherwise(F.col("size"))
    end = F.col("start") + F.col("size")
    fresh = F.coalesce(F.col("start") - F.lag(end).over(order) >= gap, F.lit(True))
    placed = repeats(docs, **how).distinct().withColumn("_new", fresh).withColumn("_run", F.count_if("_new").over(order))
    within = Window.partitionBy(*row, "_run")
    by_row = (
        placed.withColumns({"_length": F.max(end).over(within) - F.min("start").over(within), "_largest": F.max("size").over(within)})
        .withColumn("_passage", (F.col("_length") >= run) & (F.col("_largest") >= anchor))
        .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        .agg(
            F.sum(F.when(F.col("_passage"), F.col("size"))).alias("n_repeated"),
            F.sum(F.when(F.col("_passage"), again)).alias("n_removed"),
            F.array_sort(F.collect_list(F.when(F.col("_passage") & ~F.col("first"), F.struct("start", end.alias("end"))))).alias("gone"),
            F.sum("size").alias("n_equal"),
            F.sum(again).alias("n_again"),
        )
    )
    rows = keyed(docs).select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"))
    spans = F.array_join(F.transform("gone", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.join(by_row, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(spans, F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_equal", "n_again")],
    )


def removed(text: bytes, spans: str) -> bytes:
    """``text`` without the spans that :func:`deduplicate` lists."""
    out, at = [], 0
    for s in filter(None, spans.split(",")):
        a, b = map(int, s.split(":"))
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
