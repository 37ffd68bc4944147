"""The operators bound to their tables: one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("long").alias("n_markov"),
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import columns

    # Passages of 51 words have 300 bytes or more, but for one in fifty.
    found = columns.deduplicate(read(spark, sf_dir, "documents"), short=300)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(read(spark, sf_dir, "documents")).drop("th")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.match(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near(read(spark, sf_dir, "embeddings"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chunks

    return chunks.deduplicate(read(spark, sf_dir, "documents"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    tree, tokens = suffix.learn(docs.where(~held_out))
    return suffix.score(docs, tree, tokens).withColumn("held_out", held_out)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefixes

    return prefixes.trie(read(spark, sf_dir, "conversations"), block=20).drop("n1", "n2")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(read(spark, sf_dir, "pages"), path)
    return warc.opened(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    mine = (op1_secret_scans, op2_license_scans, op3_language_id, op4_repeated_strings, op5_jaccard_join, op6_decontaminate, op7_embedding_dedup, op8_chunk_dedup, op9_mix_sources, op10_suffix_tree_scores, op11_conversation_trie, op12_centroid_clusters, op13_web_archive)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    from . import centroids, licenses, mixing, prefixes, sql, warc

    return {
        "op2_license_scans": licenses.sql("documents"),
        "op4_repeated_strings": sql.REPEATED_STRINGS,
        "op5_jaccard_join": sql.JACCARD_JOIN,
        "op7_embedding_dedup": sql.EMBEDDING_LINKS,
        "op9_mix_sources": mixing.SQL.format(docs="documents", columns=""),
        "op11_conversation_trie": prefixes.SQL,
        "op12_centroid_clusters": centroids.sql(),
        "op13_web_archive": warc.SQL,
    }
