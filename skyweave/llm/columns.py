"""Repeated strings by column-wise suffix construction.

Pieces of text that may hold a repeated string are collected so that equal
strings stand at equal columns. From the last column to the first, each round
inserts one symbol of every piece: the order of the pieces by what follows is
sorted stably by the new symbol, and the common prefixes of neighbours are
updated from those of the round before. Rounds are written one after another
to an external file and read back in sequence to report what repeats.

How pieces are found: of the K-byte grams in each window of bytes, the one
with the least digest is its anchor, so equal windows have equal anchors at
equal places. Windows in a row with one anchor are a piece. Only pieces whose
anchor occurs again are looked at; pieces equal as a whole repeat as a whole.
An anchor with very many different pieces, such as a line that a third of all
texts hold, makes no group for one task: its windows are narrowed down by
digests of what neighbouring windows share, counted over the whole table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut, keyed, same_row
from .textbytes import blocks, prefix, ranges, runs, utf8

K = 64


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima to the
    left and to the right of every ``width``-th entry."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    pad = -len(keys) % width
    full = np.concatenate((keys, np.full(pad, np.iinfo(keys.dtype).max, keys.dtype))).reshape(-1, width)
    right = np.minimum.accumulate(full, 1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(start, windows, anchor, digest of the anchor)`` of the pieces of all
    texts, as places in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = ranges(prefix(data), np.arange(len(data) - K + 1), np.arange(K, len(data) + 1))
    # The place breaks ties: the leftmost, as it stands in every equal window.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (least(key, length - K + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.arange(len(anchor))
    owner = np.searchsorted(offsets, first, "right") - 1
    inside = first + length <= offsets[owner + 1]
    first, anchor = first[inside], anchor[inside]
    start, count = runs(anchor)
    return first[start], count, anchor[start], h[anchor[start]]


PIECES = "doc_id long, th long, h long, dg long, start long, windows int, lead int, size int"


def listed(docs: DataFrame, short: int, length: int) -> DataFrame:
    """All pieces with the digests of anchor and whole. Windows have ``short``
    bytes; a piece reaches as far as strings of ``length`` bytes that begin
    with them, or to its text's end."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for i, j in blocks(offsets):
                part, inner = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, windows, anchor, h = pieces(part, inner, short)
                owner = np.searchsorted(inner, start, "right") - 1
                ends = np.minimum(start + windows - 1 + length, inner[owner + 1])
                raw = part.tobytes()
                dg = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), ends.tolist())], np.uint64)
                take = pa.array(owner + i)
                whole = [h.view(np.int64), dg.view(np.int64), start - inner[owner], windows.astype(np.int32), (anchor - start).astype(np.int32), (ends - start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, whole)], names=[f.split()[0] for f in PIECES.split(", ")])

    return keyed(docs).mapInArrow(run, PIECES)


def construct(frame: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds ``(column, order, common)`` from the last column to the first:
    the pieces that reach the column, sorted in their group by what follows it,
    the column included, and how many symbols each shares with the one before.

    ``frame[piece, column]`` holds the symbols from ``first`` to ``last``."""
    m, width = frame.shape
    by_last, by_first = np.argsort(last, kind="stable"), np.argsort(first, kind="stable")
    enter = np.searchsorted(last[by_last], np.arange(width + 1))
    leave = np.searchsorted(first[by_first], np.arange(width + 2))
    symbols = np.asfortranarray(frame)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in range(width - 1, -1, -1):
        if leave[x + 2] > leave[x + 1] and len(order):
            stay = np.flatnonzero(first[order] <= x)
            if len(stay):
                begin = np.concatenate(([0], stay[:-1] + 1))
                common = np.minimum.reduceat(common[: stay[-1] + 1], begin)
                order = order[stay]
            else:
                order, common = order[:0], common[:0]
        new = by_last[enter[x] : enter[x + 1]]
        if len(new):
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new), np.int64), common))
            place = np.argsort(group[order], kind="stable")
            order, common = order[place], common[place]
        if not len(order):
            continue
        key = group[order] * 256 + symbols[order, x]
        place = np.argsort(key, kind="stable")
        key = key[place]
        bounds = np.empty(2 * len(place) - 2, np.int64) if len(place) > 1 else np.zeros(0, np.int64)
        fresh = np.zeros(len(place), np.int64)
        if len(bounds):
            bounds[0::2], bounds[1::2] = place[:-1] + 1, place[1:] + 1
            same = key[1:] == key[:-1]
            # Only neighbours of one symbol ask; their bounds rise.
            ask = np.flatnonzero(same)
            if len(ask):
                pairs = np.empty(2 * len(ask), np.int64)
                pairs[0::2], pairs[1::2] = bounds[0::2][ask], bounds[1::2][ask]
                fresh[ask + 1] = 1 + np.minimum.reduceat(np.append(common, 0), pairs)[0::2]
        order, common = order[place], fresh
        yield x, order, common


def repeated(rows: list[dict], short: int, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each piece, which of its windows of ``short`` bytes occur in another
    piece of its group, and which of those of ``length`` bytes. ``rows`` have
    ``h, lead, windows, bytes``."""
    reach = short - K
    lead = np.array([r["lead"] for r in rows])
    windows = np.array([r["windows"] for r in rows])
    size = np.array([len(r["bytes"]) for r in rows])
    first = reach - lead
    _, group = np.unique([r["h"] for r in rows], return_inverse=True)
    frame = np.zeros((len(rows), int((first + size).max())), np.uint8)
    for k, r in enumerate(rows):
        frame[k, first[k] : first[k] + size[k]] = np.frombuffer(r["bytes"], np.uint8)
    found = [np.zeros(w, bool) for w in windows], [np.zeros(w, bool) for w in windows]
    with tempfile.SpooledTemporaryFile(1 << 26) as file:  # this task's own, under a column of ``limit`` bytes; gone with it
        rounds = []
        for x, order, common in construct(frame, first, first + size - 1, group):
            file.write(order.astype(np.int32).tobytes())
            file.write(common.astype(np.int32).tobytes())
            rounds.append((x, len(order)))
        file.seek(0)
        for x, n in rounds:
            order, common = np.frombuffer(file.read(4 * n), np.int32), np.frombuffer(file.read(4 * n), np.int32)
            for hits, least_ in zip(found, (short, length)):
                long = common >= least_
                if long.any():
                    long[:-1] |= long[1:]
                    for k in order[long].tolist():
                        at = x - first[k]
                        if at < windows[k]:
                            hits[k][at] = True
    return found


SPANS = "doc_id long, th long, a long, b long, long boolean"
_SPANS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("long", pa.bool_())])


def _reported(short: int, length: int, limit: int):
    """Streams groups in anchor order, gathers them up to ``limit`` bytes and
    reports the repeated stretches of pieces that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        volume = 0

        def work() -> pa.RecordBatch:
            out: list[tuple] = []
            for hits, size in zip(repeated(held, short, length), (short, length)):
                for r, hit in zip(held, hits):
                    if r["copies"] > 1:
                        continue
                    for s, c in zip(*(x.tolist() for x in runs(hit))):
                        if hit[s]:
                            out.append((r["doc_id"], r["th"], r["start"] + s, r["start"] + s + c - 1 + size, size == length))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, _SPANS)], schema=_SPANS)

        seen: set = set()
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["h"] != last:
                    if volume >= limit:
                        yield work()
                        held.clear()
                        volume = 0
                    last, seen = r["h"], set()
                if r["dg"] in seen:  # a repeated row brings its pieces twice
                    continue
                seen.add(r["dg"])
                held.append(r)
                volume += len(r["bytes"])
        if held:
            yield work()

    return run


#: How many neighbouring windows are judged together, round by round.
CLASSES = (64, 8, 1)


def _classes(short: int, size: int, step: int):
    """For each class of ``step`` neighbouring columns in which a piece has
    windows of ``size`` bytes: digests of all that these windows cover
    (``whole``) and of what all windows of the class cover (``core``). With
    ``up``, only the classes within those of the round before are looked at."""
    wide = CLASSES[max(0, CLASSES.index(step) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "th", "start", "class", "a", "b", "whole", "core")}
            for r in batch.to_pylist():
                first = short - K - r["lead"]
                end = first + min(r["windows"], len(r["bytes"]) - size + 1)  # columns of windows, end exclusive
                up = None if r["up"] is None else set(r["up"])
                for q in range(first // step, (end - 1) // step + 1) if end > first else ():
                    if up is not None and q * step // wide not in up:
                        continue
                    x, y = max(first, q * step), min(end, (q + 1) * step) - 1
                    key = b"%d %d %d %d %d " % (r["h"], size, step, x, y)
                    whole = xxhash.xxh3_128_digest(key + r["bytes"][x - first : y - first + size])
                    core = xxhash.xxh3_128_digest(b"core %d %d %d %d " % (r["h"], size, step, q) + r["bytes"][(q + 1) * step - 1 - first : q * step + size - first])
                    for n, v in zip(out, (r["doc_id"], r["th"], r["start"], q, r["start"] + x - first, r["start"] + y - first + size, whole, core)):
                        out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n in ("whole", "core") else pa.int64()) for n, v in out.items()], names=list(out))

    return run


def crowded(texts: DataFrame, short: int, size: int) -> DataFrame:
    """Spans as in ``SPANS`` without ``long``: repeated windows of ``size``
    bytes of the pieces ``texts``, whatever the number of pieces with one
    anchor.

    Windows at neighbouring columns are judged together: where all they cover
    occurs in another piece, all of them repeat; where what each of them
    covers does not, none does. Only what is left goes on to narrower classes,
    at last to single windows. Digests are counted with map-side combining, so
    a very common one crowds no task."""
    piece = ["doc_id", "th", "start"]
    state = texts.select(*piece, "h", "lead", "windows", "bytes", F.lit(None).cast("array<bigint>").alias("up"))
    found = None
    for step in CLASSES:
        keys = cut(state.mapInArrow(_classes(short, size, step), "doc_id long, th long, start long, class long, a long, b long, whole binary, core binary"))
        again = cut(keys.distinct().groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole", F.lit(True).alias("settled")))
        judged = cut(keys.join(again, "whole", "left"))
        hits = judged.where("settled").select("doc_id", "th", "a", "b")
        found = hits if found is None else found.union(hits)
        if step == CLASSES[-1]:
            break
        unsure = F.count_if(F.col("settled").isNull())
        shared = cut(judged.distinct().groupBy("core").agg(F.count("*").alias("n"), unsure.alias("unsure")).where("n > 1 and unsure > 0").select("core"))
        more = judged.join(shared, "core")
        # What is settled goes on too, once for each content, for others to meet.
        met = more.where("settled").groupBy("whole").agg(F.min(F.struct(*piece, "class")).alias("one")).select("one.*")
        alive = more.where("settled is null").select(*piece, "class").union(met).groupBy(*piece).agg(F.collect_set("class").alias("up"))
        one = state.drop("up").alias("s")
        near = (F.col("s.th") == alive["th"]) & (F.col("s.start") == alive["start"]) & F.col("s.doc_id").eqNullSafe(alive["doc_id"])
        state = one.join(alive, near).select("s.*", "up")
    return found


def spans(docs: DataFrame, length: int = 400, short: int | None = None, limit: int = 4 << 20, group: int = 1024) -> DataFrame:
    """``(doc_id, th, a, b, long)``: stretches of bytes, each a union of
    windows of ``length`` bytes (``long``) or of ``short`` that occur
    elsewhere too, in the table or the same text. They may overlap. Anchors
    with more than ``group`` kinds of pieces are left to :func:`crowded`."""
    short = length if short is None else short
    listing = listed(docs, short, length)
    again = cut(listing.groupBy("h").agg(F.count("*").alias("n"), F.min("dg").alias("x"), F.max("dg").alias("y")).where("n > 1").select("h", (F.col("x") != F.col("y")).alias("mixed")))
    # The pieces are listed twice rather than kept.
    mine = cut(listing.join(again, "h"))
    mixed_ = mine.where("mixed")
    kinds = cut(mixed_.groupBy("h", "dg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "windows", "lead")).alias("one")))
    rows_ = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    crowds = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > group).select("h", F.lit(True).alias("crowd")))

    def whole(df: DataFrame) -> DataFrame:
        span = lambda windows, size, long: F.struct(F.col("start").alias("a"), (F.col("start") + windows - 1 + size).alias("b"), F.lit(long).alias("long"))
        both = F.array(span(F.col("windows"), short, False), span(F.least(F.col("windows"), F.col("size") - length + 1), length, True))
        return df.select("doc_id", "th", F.inline(both)).where(F.col("b") - F.col("a") >= F.when(F.col("long"), length).otherwise(short))

    # Pieces with very many copies, at most 2**16 kinds, go to every task: by
    # their key, all their rows would meet in one.
    twice = kinds.where("copies > 1")
    bound = max(1000, rows_ >> 16)
    many = F.broadcast(twice.where(F.col("copies") > bound).select("h", "dg"))
    few = twice.where(F.col("copies") <= bound).select("h", "dg")
    copies = mixed_.join(many, ["h", "dg"], "left_semi").union(mixed_.join(many, ["h", "dg"], "left_anti").join(few, ["h", "dg"], "left_semi"))
    asked = kinds.join(crowds, "h", "left").select("one.doc_id", "one.th", F.struct("h", "dg", "copies", "one.start", "one.windows", "one.lead", F.coalesce("crowd", F.lit(False)).alias("crowd")).alias("piece"))
    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list("piece").alias("pieces"))
    rows = keyed(docs)
    found = rows.join(wanted.hint("shuffle_hash"), same_row(rows, wanted)).select(rows["doc_id"], rows["th"], "text", "pieces")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for k, (doc_id, th, mine) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                out = [dict(p, doc_id=doc_id, th=th, bytes=text[p["start"] : p["start"] + p["windows"] - 1 + length]) for p in mine]
                for lo in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[lo : lo + 10_000], schema=fetched)

    fetched = pa.schema([("h", pa.int64()), ("dg", pa.int64()), ("copies", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("lead", pa.int32()), ("crowd", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("bytes", pa.binary())])
    texts = found.mapInArrow(fetch, "h long, dg long, copies long, start long, windows int, lead int, crowd boolean, doc_id long, th long, bytes binary")
    none = crowds.isEmpty()
    if not none:
        texts = cut(texts)
    compared = texts.where("not crowd").repartition("h").sortWithinPartitions("h").mapInArrow(_reported(short, length, limit), SPANS)
    out = whole(mine.where("not mixed")).union(whole(copies)).union(compared)
    if not none:
        crowd = texts.where("crowd").drop("crowd")
        for size in sorted({short, length}):
            out = out.union(crowded(crowd, short, size).withColumn("long", F.lit(size == length)))
    return out


def deduplicate(docs: DataFrame, length: int = 400, short: int | None = None, **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed,
    n_spans, n_repeated, kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else in the table, the same text included; strings lie within
    one text and are judged on the input. ``n_spans`` counts the maximal runs
    of removed bytes, ``kept`` is what stays. ``n_repeated`` counts the bytes
    that repeated strings of ``short`` bytes (not above ``length``, which it
    is by default) cover: passages too short to be removed. Null texts are
    empty; texts shorter than ``length`` stay whole; of repeated rows each is
    the other's repetition; other columns do not matter."""
    found = cut(spans(docs, length, short, **how))
    gone = found.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "long")).alias("gone"))
    rows = keyed(docs)
    joined = rows.join(gone.hint("shuffle_hash"), same_row(rows, gone), "left").select(rows["doc_id"], "text", "gone")

    def union(stretches: Iterator[tuple[int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for a, b in sorted(stretches):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "n_repeated": [], "kept": []}
            for k, stretches in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                away = union((s["a"], s["b"]) for s in stretches or () if s["long"])
                seen = union((s["a"], s["b"]) for s in stretches or ())
                edges = [0, *(x for s in away for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for c, v in zip(out, (len(text), sum(b - a for a, b in away), len(away), sum(b - a for a, b in seen), kept)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.int64()) for c in list(out)[:4]), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")
