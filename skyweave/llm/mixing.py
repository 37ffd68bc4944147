"""Mixing sources to target weights.

Capped water-filling sets each source's target; whole and fractional
repetitions of its documents, drawn by a seeded digest, fill it. DataFrame and
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# The form of a word, and the weights that sources take in turn.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)


def draw(docs: DataFrame, seed: str) -> Column:
    """A document's place in the seeded order of its source: by its id, or
    where that is null by its text, so that rows without ids are spread too."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null "), F.md5(text)))))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, with ``target``.

    Sources in code point order, null last, take ``weights`` in turn. Water at
    level L gives a source ``least(cap * size, L * weight)``; L is where these
    add up to ``share`` of all sizes. Sources are capped in the order of
    ``cap * size / weight``, so L follows from sums over that order: it is the
    level of the shortest run of capped sources whose rest stays below its own
    caps. The windows run over one row a source."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_w", pick)
        .withColumn("_ratio", full / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("_w").over(after))
        # The first source in order that its level does not fill sets the level of all.
        .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"])
        .withColumn("target", F.when(F.col("_water").isNull(), full).otherwise(F.least(full, F.col("_water") * F.col("_w"))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size,
    target, taken``.

    A source at ``target / source_size`` epochs repeats each document as many
    whole times as that has; of the rest, the documents that come first in the
    seeded order are taken once more, while their words, half of the last
    one's included, stay within it. So a source's taken words differ from its
    target by at most half of one document, and reruns agree.

    The order is kept in two levels: 4096 ranges of the digest, summed with
    map-side combining, and the documents within a range. A source that holds
    a third of all rows is thus spread over 4096 groups. A null text has size
    0; a null source is a source of its own, the last; rows that share an id, or
    without one a text, share a place in the order; other columns are not looked at. An empty
    table gives an empty result."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = cut(docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), draw(docs, seed).alias("_place")).withColumn("_range", F.substring("_place", 1, 3)))
    ranges = slim.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    plan = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), share, cap, weights)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).alias("r")
    plan = plan.withColumnRenamed("source", "_s")
    ranges = ranges.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target", "_whole", "_rest")
    rows = slim.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    within = Window.partitionBy("_s", "_r").orderBy("_place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("size").over(within)
    once = F.when(upto - F.col("size") / F.lit(2.0) <= F.col("_rest"), F.col("size")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + once).cast("long").alias("taken"))


#: What ``mix`` says, for an engine with SQL; ``{docs}`` names the input.
SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))) AS place
  FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM sizes),
ratios AS (SELECT *, source_size * CAST(2 AS DOUBLE) / w AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(source_size * CAST(2 AS DOUBLE)) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
water AS (SELECT arg_min(level, ratio) AS water FROM levels WHERE level <= ratio),
plan AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN source_size * CAST(2 AS DOUBLE) ELSE least(source_size * CAST(2 AS DOUBLE), water * w) END AS target
  FROM levels LEFT JOIN water ON true),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
run AS (
  SELECT doc_id, s.source, size, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN whole p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, {columns}size, source_size, target,
       CAST(whole * size + CASE WHEN upto - size / CAST(2 AS DOUBLE) <= rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM run
"""
