"""From raw documents to a weighted mix, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import decontaminate, jaccard, language, mixing, secrets
from skyweave.llm.common import cut, read

#: What counts as evidence against a text: so many n-grams at least, of which
#: its language has under this share. It does not depend on how many languages
#: there are.
ENOUGH, LEAST_SHARE = 40, 0.03


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the languages of the labelled documents, which
    the filter is fitted on; ``lang`` becomes what was predicted.

    Texts that are null, empty or without a letter go. So do those with enough
    n-grams of which hardly any belongs to the best language. A text too short
    to tell stays, and so does one in two of the languages. Each row is judged by
    itself: repeats stay, an empty table stays empty, other columns are kept."""
    found = language.predict(docs, language.fit(docs))
    none = (F.col("n_grams") >= ENOUGH) & (F.col("n_best") < LEAST_SHARE * F.col("n_grams"))
    kept = found.where((F.col("lang_pred") != "und") & ~none)
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the least doc_id. Rows
    equal in id and text are one class, as are equal texts; null and empty
    texts and those without words are in no class and stay; null ids come
    last. An empty table stays empty."""
    return jaccard.distinct(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of ``benchmark`` occurs. Null and
    empty texts and items match nothing; repeated rows share their fate; an
    empty table on either side drops nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with a mark in place of each secret; ``n_chars``
    follows the text and is null where that is. Columns named ``base`` or
    ``spans`` do not get in the way."""
    names = {c: f"_own_{c}" for c in docs.columns if c in ("base", "spans")}
    done = secrets.redact(docs.withColumnsRenamed(names)).withColumn("n_chars", F.length("text").cast("long"))
    return done.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document the words it takes and its source's target,
    as ``mixing.mix`` names them; other columns end here. A null text has no
    words, a null source is a source, repeated rows count each."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("mixing sources to target weights", mixed),
]

#: Trained filters, near copies and edit distances are beyond SQL; tests hold
#: each stage's rows, and the result, against plain versions of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and reread."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
