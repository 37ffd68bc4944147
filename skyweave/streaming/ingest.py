"""Observations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyweave.functions import calendar as C
from skyweave.sources.grid import append_unseen


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's unseen rows to ``store`` and stop when the files
    at hand are done. Late files are taken at any time; a batch that runs
    twice appends once, as its rows are no longer unseen."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_unseen(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, res: str, late: str = "40 days") -> DataFrame:
    """``(closes, period, lat_i, lon_i, value, n_valid)``: sums by cell and
    calendar period. A period closes when observations have come of one that
    ends ``late`` after it: the watermark is on ``closes``, the moment at which
    the period ends, so its sum is given out once and its state is dropped.
    What comes later for it is left out."""
    start = C.period_start(F.col("time"), res)
    rows = stream.withColumns({"period": start, "closes": F.date_add(C.period_end(F.col("time"), res), 1).cast("timestamp")}).withWatermark("closes", late)
    return rows.groupBy("closes", "period", "lat_i", "lon_i").agg(F.sum("value").alias("value"), F.count("value").alias("n_valid"))
