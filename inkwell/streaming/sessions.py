"""Pen sessions from timed samples: the same plan for a stream (with a watermark) and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Runs of samples less than `gap` apart: start, end, samples, total."""
    if df.isStreaming and watermark:
        df = df.withWatermark(ts, watermark)
    out = df.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("samples"), F.sum(value).alias("total"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "samples", "total")


def append_new(spark, source: DataFrame, path: str, key: str, checkpoint: str):  # noqa: ANN001, ANN201
    """Stream rows whose key is not in the table at path yet, micro-batch by micro-batch, and append them."""

    def add(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema(batch.schema).parquet(path)
        batch.dropDuplicates([key]).join(known.select(key), key, "left_anti").write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
