"""Streams: an append-only response log that resumes, and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import append_once, ledger, read_log, refused_rows

__all__ = ["append_once", "ledger", "read_log", "refused_rows", "response_log", "runtime_windows"]


def response_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the response files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def runtime_windows(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Counts and mean seconds of successful rows by tumbling window; state is dropped once the watermark has passed."""
    ok = F.col("status") == "ok"
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col("elapsed_seconds"))).alias("mean_seconds"))
        .select(F.col("w.start").alias("start"), "n", "n_ok", "mean_seconds")
    )
