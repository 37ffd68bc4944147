"""What the operators share: row keys, the shared folder, grouped tasks and
connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only where the session names none and all runs in one process (tests) is
    one made; on a cluster that would be another folder on each machine, and
    the lack of one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skyweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends there: a lost executor costs the reread of one file, and
    later joins see plain shuffles on both sides, which AQE can split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, text)``: what identifies a row is its id together with
    its text. Rows equal in both are interchangeable, so that results found
    for one hold for all; ids may be null or repeat."""
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the key of :func:`keyed`, nulls equal."""
    return (a["th"] == b["th"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def grouped(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn`` once for each group of ``keys`` with the group's columns as
    lists; ``fn`` yields dicts of equally long lists.

    One task streams through many small groups in key order, so there is no
    start-up cost for each group, and only one group is held at a time. The
    caller bounds the size of a group."""
    names = df.columns
    at = [names.index(k) for k in keys]
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        last = None
        done: list[dict] = []

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            if done and (force or sum(len(next(iter(d.values()))) for d in done) > 5000):
                cols = {f.name: [x for d in done for x in d[f.name]] for f in arrow}
                done.clear()
                yield pa.RecordBatch.from_pydict(cols, schema=arrow)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            ids = list(zip(*(cols[i] for i in at)))
            start = 0
            for i in range(len(ids) + 1):
                if i < len(ids) and ids[i] == (ids[i - 1] if i > start else last):
                    continue
                if i > start:
                    for h, c in zip(held, cols):
                        h.extend(c[start:i])
                if i == len(ids):
                    break
                if held[0]:
                    done.extend(fn(dict(zip(names, held))))
                    yield from flush(False)
                held = [[] for _ in names]
                start, last = i, ids[i]
            if ids:
                last = ids[-1]
        if held[0]:
            done.extend(fn(dict(zip(names, held))))
        yield from flush(True)

    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest
    node that can be reached.

    Each round takes the least label among a node's neighbours and then the
    label of that label (pointer jumping), so the number of rounds grows with
    the logarithm of a chain's length. Labels meet in ``min`` aggregates,
    which combine before the shuffle; the joins read written tables, so that
    AQE can split a node with very many links. Nothing is collected but
    whether a label changed. Raises if ``rounds`` do not suffice."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        moved = cut(step.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("top", "mid")).alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still move after {rounds} rounds")
