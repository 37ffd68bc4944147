"""Language identification by bit-sliced Bloom filters.

One filter for all languages: each slot holds a bitmask of languages, and the
masks at an n-gram's slots, and-ed, name every language whose filter holds it.
A text's n-grams are counted for each language; from a count, what chance hits
of a filter as full as that one would add is taken off, and the largest rest
decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import ship

from .common import text_of
from .textbytes import MIX, blocks, mixed, utf8

#: Sampled texts for each text more that must hold an n-gram; n-grams that a
#: language counts as having, at least.
FEW, THIN = 20, 20_000

_fold: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Of each code point its lower-case letter, or 32 for what is no letter."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _fold.append(table)
    return _fold[0]


def letters(texts: bytes) -> np.ndarray:
    """Code points of UTF-8 text, folded."""
    return folded()[np.frombuffer(texts.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]


def grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams that hold a letter, and where each starts."""
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = points[: len(points) - n + 1].astype(np.uint64)
    some = points[: len(points) - n + 1] != 32
    for k in range(1, n):
        p = points[k : len(points) - n + 1 + k]
        h = h * np.uint64(0x110001) + p
        some = some | (p != 32)
    at = np.flatnonzero(some)
    return mixed(h[at] * MIX), at


@dataclass(frozen=True)
class Filter:
    """``masks[word, slot]``: bits of languages, 64 a word; ``rate``: each
    language's share of chance hits, which is its share of set slots to the
    number of hashes."""

    langs: tuple[str, ...]
    masks: np.ndarray
    rate: np.ndarray
    n: int
    hashes: int

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(self.masks.shape[1] - 1)
        for k in range(self.hashes):
            yield ((h >> np.uint64(20 * k)) & size).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        first, *rest = self.slots(h)
        out = self.masks[:, first]
        for s in rest:
            out = out & self.masks[:, s]
        return out

    def narrow(self) -> "Filter":
        """The same with masks of one byte where eight bits do."""
        return Filter(self.langs, self.masks.astype(np.uint8), self.rate, self.n, self.hashes) if len(self.langs) <= 8 else self


def fit(docs: DataFrame, n: int = 4, per_language: int = 1500, share: float = 0.5, least: int = 3, bits: int = 20, hashes: int = 2, max_languages: int = 1024) -> Filter:
    """A filter from the labelled rows of ``docs(doc_id, text, lang)``.

    It is fitted on a bounded sample: about ``per_language`` rows of each
    language, those whose digest of id and text is lowest. An n-gram belongs
    to a language where at least ``least`` of the sampled texts hold it (fewer
    where few were sampled: one, and one more for each ``FEW``) and its
    frequency is at least ``share`` of what it is where it is highest; a
    language of few n-grams counts as one of ``THIN`` there, as a text or two
    say little of frequencies.
    The masks go to every task, eight megabytes for each 64 languages: more
    than ``max_languages`` raise an error. Rows with a null language or text teach nothing."""
    ship(docs.sparkSession)
    use = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), text_of(docs).alias("text"), F.col("doc_id").cast("string").alias("_id"))
    place = F.pmod(F.xxhash64("_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    totals = use.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = tuple(r["lang"] for r in totals)
    if not langs:
        return Filter((), np.zeros((1, 1), np.uint64), np.zeros(0), n, hashes)
    rate = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, per_language / r["count"]))]), F.col("lang"))
    chosen = use.where(place < rate).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            lang = batch.column(0).to_pylist()
            for i in range(len(lang)):
                h, _ = grams(letters(b" " + data[offsets[i] : offsets[i + 1]].tobytes() + b" "), n)
                u, c = np.unique(h, return_counts=True)
                held.setdefault(lang[i], []).append((u, c))
        for x, parts in held.items():
            h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
            if len(start):
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(start)), pa.array(h[start].view(np.int64)), pa.array(np.add.reduceat(c, start)), pa.array(np.diff(np.append(start, len(h))))], names=["lang", "h", "c", "d"])

    counts = chosen.mapInArrow(count, "lang string, h long, c long, d long").groupBy("lang", "h").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    need = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(least, 1 + min(r["count"], per_language) // FEW))]), F.col("lang"))
    counts = counts.where(F.col("d") >= need)
    found = counts.toArrow()  # bounded by the sample
    code = np.array([langs.index(x) for x in found["lang"].to_pylist()], np.int64)
    h = found["h"].to_numpy().view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
    c = found["c"].to_numpy().astype(float) if found.num_rows else np.zeros(0)
    per = np.bincount(code, c, len(langs)) if len(code) else np.ones(len(langs))
    f = c / np.maximum(per[code], THIN)
    order = np.lexsort((code, h))
    h, f, code = h[order], f[order], code[order]
    if len(h):
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        top = np.repeat(np.maximum.reduceat(f, start), np.diff(np.append(start, len(h))))
        keep = f >= share * top
        h, code = h[keep], code[keep]
    made = Filter(langs, np.zeros((-(-len(langs) // 64), 1 << bits), np.uint64), np.zeros(len(langs)), n, hashes)
    for s in made.slots(h):
        np.bitwise_or.at(made.masks, (code // 64, s), np.uint64(1) << (code % 64).astype(np.uint64))
    for k in range(len(langs)):
        made.rate[k] = np.mean((made.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** hashes
    return made


def _pieces(offsets: np.ndarray, data: np.ndarray, n: int, limit: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first, points)``: the folded code points of some texts from the
    ``first`` on, with a space on both sides of each; of a text of more than
    ``limit`` bytes one piece at a time, each with the ``n - 1`` code points
    before it, so that its n-grams are those of the whole text."""
    for i, j in blocks(offsets, limit):
        if offsets[j] - offsets[i] <= limit or j > i + 1:
            yield i, [letters(b" " + data[offsets[d] : offsets[d + 1]].tobytes() + b" ") for d in range(i, j)]
            continue
        before, at = np.full(1, 32, np.uint32), offsets[i]
        while at < offsets[j]:
            end = min(at + limit, offsets[j])
            while end < offsets[j] and data[end] & 0xC0 == 0x80:  # within a character
                end += 1
            own = letters(data[at:end].tobytes() + (b" " if end == offsets[j] else b""))
            yield i, [np.concatenate((before, own))]
            before, at = np.concatenate((before, own))[-(n - 1) :] if n > 1 else own[:0], end


def _judge(model: Filter, offsets: np.ndarray, data: np.ndarray, limit: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """Each text's language, as an index or -1, and score, its n-grams, and
    the corrected counts of the first two languages. Memory is bounded by
    ``limit``, whatever the length of a text."""
    docs, langs = len(offsets) - 1, len(model.langs)
    hits, total, some = np.zeros((docs, langs)), np.zeros(docs), np.zeros(docs, bool)
    for i, parts in _pieces(offsets, data, model.n, limit):
        j = i + len(parts)
        first = np.cumsum([0, *map(len, parts)])
        points = np.concatenate(parts)
        some[i:j] |= np.add.reduceat(points != 32, first[:-1]) > 0
        h, at = grams(points, model.n)
        owner = np.searchsorted(first, at, "right") - 1
        fits = at + model.n <= first[owner + 1]
        mask, owner = model.lookup(h[fits]), owner[fits]
        total[i:j] += np.bincount(owner, minlength=j - i)
        edges = np.searchsorted(owner, np.arange(j - i + 1))
        one = mask.dtype.type(1)
        for k in range(langs):
            ones = np.concatenate(([0], np.cumsum((mask[k // 64] >> mask.dtype.type(k % 64)) & one, dtype=np.int64)))
            hits[i:j, k] += ones[edges[1:]] - ones[edges[:-1]]
    if not langs:
        return np.full(docs, -1), np.zeros(docs), total, np.zeros(docs), np.zeros(docs)
    real = np.maximum(hits - total[:, None] * model.rate, 0) / (1 - np.minimum(model.rate, 0.999))
    best = np.where(some, np.argmax(real, 1), -1)
    ranked = np.sort(np.concatenate((np.zeros((docs, 1)), real), 1), 1)
    score = np.where(ranked[:, -1] > 0, (ranked[:, -1] + 1) / (real.sum(1) + langs), 0.0)
    return best, np.where(some, np.clip(score, 0, 1), 0.0), total, ranked[:, -1], ranked[:, -2]


RESULT = "struct<lang_pred:string,score:double,n_grams:double,n_best:double,n_second:double>"


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, and what they rest on:
    ``n_grams`` of the text and the corrected counts ``n_best`` and
    ``n_second`` of the first two languages; columns of these names are
    replaced, others stay. A text that is null or has no letter is ``und`` with
    score 0. The score is the corrected count of the language as a share of all
    languages' counts, one pseudo-count each, and 0 where no n-gram is known.
    Ties go to the language that is first by code points, that of no known
    n-gram too; row order and repeats stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model.narrow())  # a fixed number of slots
    names = np.array([*model.langs, "und"], object)

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        best, *rest = _judge(shared.value, *utf8(texts))
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), *map(pa.array, rest)], names=["lang_pred", "score", "n_grams", "n_best", "n_second"])

    found = docs.withColumn("_found", judge(text_of(docs)))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "n_grams", "n_best", "n_second")}).drop("_found")
