"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most e edits leaves at least one of
its e + 1 pieces untouched. An Aho-Corasick automaton finds exact hits of all
pieces in one pass over a text; around each hit whose neighbouring piece can be
there too, Myers' bit-parallel recurrence computes the least edit distance to
any stretch.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import cut, text_of

Q = 3
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, letters and digits only, one space between words."""
    return _GAP.sub(" ", text.lower()).strip()


def budget(length: int, rate: float, piece: int = 0) -> int:
    """Edits allowed for an item: ``rate`` of its length. ``piece`` does not
    lessen them: where they leave shorter pieces, those are searched."""
    return int(length * rate)


def grams(text: str) -> set[str]:
    return {text[i : i + Q] for i in range(len(text) - Q + 1)}


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into ``edits + 1`` pieces of nearly equal length."""
    at = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def beside(item: str, edits: int) -> list[tuple[int, str, int, str, str]]:
    """``(at, piece, side, one, two)``: each piece with its neighbour in halves,
    the neighbour after it where ``side`` is 1, before it where -1.

    Pieces go in pairs. Were each pair spoiled twice, and a last piece without
    a neighbour (``side`` 0) once, the edits would be more than ``edits``; so an
    occurrence has a piece untouched whose neighbour has one edit at most."""
    cut = pieces(item, edits)
    out = []
    for k, (at, p) in enumerate(cut):
        side = 0 if k % 2 == 0 and k + 1 == len(cut) else 1 - k % 2 * 2
        near = cut[k + side][1] if side else ""
        out.append((at, p, side, near[: len(near) // 2], near[len(near) // 2 :]))
    return out


def goes_on(text: str, a: int, b: int, side: int, one: str, two: str) -> bool:
    """Whether a piece at ``text[a:b]`` can have its neighbour with one edit at
    most: one half is untouched, the near one in place or the far one shifted
    by one at most."""
    if side == 0:
        return True
    if side > 0:
        return text.startswith(one, b) or text.find(two, b + len(one) - 1, b + len(one) + len(two) + 1) >= 0
    if a >= len(two) and text.startswith(two, a - len(two)):
        return True
    far = a - len(two) - len(one)
    return text.find(one, max(0, far - 1), max(0, far + len(one) + 1)) >= 0


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between a pattern of ``m`` characters and any
    stretch of ``text``, and where the first such stretch ends (Myers 1999)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items ``(id, normal text)`` in texts."""

    def __init__(self, items: list[tuple], rate: float, piece: int):
        import ahocorasick

        self.items, self.masks, self.grams, self.edits = items, {}, {}, [budget(len(t), rate, piece) for _, t in items]
        owners: dict[str, list] = {}
        for k, (_, t) in enumerate(items):
            for at, p, *near in beside(t, self.edits[k]):
                owners.setdefault(p, []).append((k, at, *near))
        self.auto = ahocorasick.Automaton()
        for p, who in owners.items():
            self.auto.add_word(p, (len(p), who))
        if owners:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """``(item id, distance, start of the search, end)`` of each item that
        occurs, at its least distance, in order of items; positions are those
        of the normal text."""
        if not self.items or not text:
            return []
        where: dict[int, list[int]] = {}
        for last, (length, who) in self.auto.iter(text):
            for k, at, side, one, two in who:
                first = last + 1 - length
                if goes_on(text, first, last + 1, side, one, two):
                    where.setdefault(k, []).append(first - at)
        out = []
        for k in sorted(where):
            id_, item = self.items[k]
            m, e = len(item), self.edits[k]
            best = (e + 1, 0, 0)
            # With no edit to spare, an item counts as whole words only.
            at = text.find(item) if e else f" {text} ".find(f" {item} ")
            if at >= 0:
                best = (0, at, at + m)
            elif e:
                if k not in self.masks:
                    masks: dict[str, int] = {}
                    for i, c in enumerate(item):
                        masks[c] = masks.get(c, 0) | 1 << i
                    self.masks[k], self.grams[k] = masks, grams(item)
                low = high = None
                for d in [*sorted(where[k]), None]:
                    if d is not None and low is not None and d - e <= high:
                        high = d + m + e
                        continue
                    if low is not None and best[0]:
                        low = max(0, low)
                        # An edit spoils at most Q of an item's grams.
                        if len(self.grams[k] & grams(text[low:high])) >= len(self.grams[k]) - Q * e:
                            distance, end = nearest(self.masks[k], m, text[low:high])
                            if distance < best[0]:
                                best = (distance, low, low + end)
                    if d is not None:
                        low, high = d - e, d + m + e
            if best[0] <= e:
                out.append((id_, *best))
        return out


MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _search(shared):
    """The column function that looks for the items of one block."""
    made: list[Matcher] = []

    @F.arrow_udf("array<struct<item_id:bigint,distance:bigint,start:bigint,end:bigint>>")
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(*shared.value))
        keys = ("item_id", "distance", "start", "end")
        return pa.array([[dict(zip(keys, x)) for x in made[0].find(normal(t.as_py() or ""))] for t in texts], MATCH)

    return search


def match(docs: DataFrame, items: DataFrame, rate: float = 0.1, piece: int = 12, block: int = 2_000_000) -> DataFrame:
    """``docs`` with ``matches``, an array of ``(item_id, distance, start,
    end)``: every item of ``items(item_id, text)`` that occurs in the whole
    text, up to case, punctuation and ``rate`` of its length in edits; items
    too short for one edit as whole words.

    Items are sent to the tasks in blocks of about ``block`` characters, so
    that no broadcast exceeds it by more than one item. Where there are several,
    each takes a pass over the texts of its own, written before the next
    begins: of a benchmark of any size, tasks hold one block at a time. Null and empty texts and items match nothing; items with the same
    text each match; repeated rows stay; other columns stay, one named
    ``matches`` is replaced."""
    spark = docs.sparkSession
    ship(spark)
    pool = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = pool.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // block))
    found = docs.withColumn("matches", F.array().cast("array<struct<item_id:bigint,distance:bigint,start:bigint,end:bigint>>"))
    for k in range(count):
        mine = pool.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else pool
        rows = sorted(((r["item_id"], normal(r["text"])) for r in mine.collect()), key=str)
        shared = spark.sparkContext.broadcast(([r for r in rows if r[1]], rate, piece))
        hits = _search(shared)(text_of(found))
        if count == 1:
            return found.withColumn("matches", hits)
        found = cut(found.withColumn("matches", F.concat("matches", hits)))
        shared.unpersist()
    return found


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no item occurs."""
    return match(docs, items, **how).where(F.size("matches") == 0).drop("matches")
