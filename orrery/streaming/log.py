"""A response log that is written batch by batch, resumes after a kill, and is never read to be written."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    """Of each key the row that came first, for good; later rows that differ from it are marked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digest string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.seen.get()[0] if self.seen.exists() else None
        for pdf in rows:
            if not len(pdf):  # a key of the first state alone
                continue
            if held is None:
                held = pdf["digest"].iloc[0]
                self.seen.update((held,))
                yield pdf.iloc[:1].assign(refused=False)
            other = pdf[pdf["digest"] != held].drop_duplicates("digest")
            if len(other):
                yield other.assign(refused=True)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        if len(initialState):
            self.seen.update((initialState["digest"].iloc[0],))

    def close(self) -> None:
        pass


def _digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


@contextmanager
def _rocks(spark: SparkSession):
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _own(checkpoint: str) -> str:
    return "c" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of ``stream`` whose ``key`` the log at ``path`` doesn't hold; each key once, whatever is killed when.

    The keys that were seen are state in ``checkpoint``, dealt by key: a batch reads
    itself and its part of the state, never the log.  Only a new checkpoint over an
    old log reads that, once, for its first state.  Batch n of a checkpoint is a
    folder of its own, replaced when the batch is run again, and then a row of the
    ledger, so a batch that died half-way leaves nothing twice.

    Rows that repeat a key with the same values are dropped; those with other values
    are kept beside the log (``refused_rows``).  Rows without a key are refused too.
    Columns run, batch and taken of the folder tell where a row came from.
    """
    spark, run, columns = stream.sparkSession, _own(checkpoint), stream.columns
    if clash := {"run", "batch", "taken"} & set(columns):
        raise ValueError(f"the log has columns of its own named {sorted(clash)}")
    # Spark hands rows over under names that mustn't begin with an underscore.
    held = {c: f"c{i}" for i, c in enumerate(columns)}
    own_key = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    rows = stream.select(*(F.col(c).alias(n) for c, n in held.items()), own_key.alias("key"), _digest(columns).alias("digest"))
    # Copies within a task's batch needn't travel.
    rows = rows.mapInPandas(lambda parts: (p.drop_duplicates(["key", "digest"]) for p in parts), rows.schema)
    out = StructType([*rows.schema, StructField("refused", BooleanType())])
    fresh = lambda: not _exists(spark, f"{checkpoint}/commits/0")
    start = None
    if fresh() and _exists(spark, f"{path}/_ledger"):
        old = read_log(spark, path).where(F.col("run") != run)
        start = old.select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("key"), _digest(columns).alias("digest"))

    def put(batch: DataFrame, number: int) -> None:
        at = f"run={run}/batch={number}"
        # One pass: a folder for what is taken and one for what isn't.
        taken = ~F.col("refused") & (F.col("key") != "")
        batch.select(*(F.col(n).alias(c) for c, n in held.items()), taken.alias("taken")).write.mode("overwrite").partitionBy("taken").parquet(f"{path}/{at}")
        counts = batch.sparkSession.read.schema(StructType([*stream.schema, StructField("taken", BooleanType())])).parquet(f"{path}/{at}").groupBy("taken").count()
        n = {r["taken"]: r["count"] for r in counts.collect()}
        ledger = batch.sparkSession.createDataFrame([(n.get(True, 0), n.get(False, 0))], "taken long, refused long")
        ledger.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/_ledger/{at}")

    def begin(first: DataFrame | None) -> StreamingQuery:
        state = {} if first is None else {"initialState": first.groupBy("key")}
        once = rows.groupBy("key").transformWithStateInPandas(_Once(), out, "Append", "None", **state)
        return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if first is None else {"once": True})).start()

    with _rocks(spark):
        if start is not None:
            # A first state goes with a first batch alone.
            query = begin(start)
            query.awaitTermination()
            if fresh():  # nothing has come yet, so the state isn't loaded
                return query
        return begin(None)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, taken, refused, at) of every batch that was finished."""
    return spark.read.schema("taken long, refused long, at timestamp, run string, batch long").option("basePath", f"{path}/_ledger").parquet(f"{path}/_ledger")


def _rows(spark: SparkSession, path: str, taken: bool) -> DataFrame:
    done = ledger(spark, path).select("run", "batch").distinct()
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    rows = rows.withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("long")})
    return rows.join(F.broadcast(done), ["run", "batch"], "left_semi").where(F.col("taken") == taken).drop("taken")  # a row for each batch


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows, of finished batches alone."""
    return _rows(spark, path, True)


def refused_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that repeated a key with other values, or had none."""
    return _rows(spark, path, False)
