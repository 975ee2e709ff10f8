"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """A folder of Parquet tables that cut lineage and survive lost executors.

    A table is written once and read back, so what follows never recomputes the
    plan above it, and the files outlive any executor.  Results are read from them
    as long as the session lasts; the folder goes when it ends.  ``options`` are the writer's.
    """

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None):
        self.spark, self.options = spark, options or {}
        self.path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex[:12]}"
        system, at = self._at("")
        system.deleteOnExit(at)

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**self.options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        system, at = self._at(name)
        system.delete(at, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()
