"""The response log: each key once through kills, batches that read themselves alone, take-over by a new checkpoint."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery import streaming

SCHEMA = "k string, v int"


def put(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))


def run(spark, tmp_path, checkpoint="cp", one_by_one=True):
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", 1) if one_by_one else reader
    streaming.append_once(reader.parquet(str(tmp_path / "in")), "k", str(tmp_path / "log"), str(tmp_path / checkpoint)).awaitTermination()


def keys(spark, tmp_path):
    return sorted((r.k, r.v) for r in streaming.read_log(spark, str(tmp_path / "log")).collect())


def test_each_key_once_through_a_kill(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, "1", [("a", 1), ("b", 2), ("a", 1)])
    run(spark, tmp_path)
    put(spark, tmp_path, "2", [("b", 2), ("c", 3), ("d", 4)])
    # The second batch dies after its rows are written and before the ledger knows of them.
    broken = {"left": 1}
    real = type(spark).createDataFrame

    def dies(self, data, schema=None, *a, **k):
        if schema == "taken long, refused long" and broken["left"]:
            broken["left"] -= 1
            raise OSError("killed")
        return real(self, data, schema, *a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(Exception, match="FOREACH_BATCH"):
        run(spark, tmp_path)
    assert keys(spark, tmp_path) == [("a", 1), ("b", 2)]  # rows of an unfinished batch aren't in the log
    run(spark, tmp_path)
    assert keys(spark, tmp_path) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    run(spark, tmp_path)
    assert len(keys(spark, tmp_path)) == 4
    assert [(r.batch, r.taken, r.refused) for r in streaming.ledger(spark, str(tmp_path / "log")).orderBy("batch").collect()] == [(0, 2, 0), (1, 2, 0)]


def test_no_batch_reads_the_log(spark, tmp_path):
    put(spark, tmp_path, "1", [("a", 1), ("b", 2)])
    run(spark, tmp_path)
    (old,) = (tmp_path / "log").glob("run=*/batch=0")
    shutil.move(old, tmp_path / "away")
    put(spark, tmp_path, "2", [("a", 1), ("c", 3)])
    run(spark, tmp_path)  # knows of a, whose rows are out of reach
    shutil.move(tmp_path / "away", old)
    assert keys(spark, tmp_path) == [("a", 1), ("b", 2), ("c", 3)]


def test_rows_that_contradict_and_rows_without_a_key(spark, tmp_path):
    put(spark, tmp_path, "1", [("a", 1)])
    put(spark, tmp_path, "2", [("a", 1), ("a", 9), (None, 5)])
    put(spark, tmp_path, "3", [("a", 9), (None, 6), ("", 7)])
    run(spark, tmp_path)
    assert keys(spark, tmp_path) == [("", 7), ("a", 1)]
    refused = streaming.refused_rows(spark, str(tmp_path / "log")).select("k", "v").distinct().collect()
    assert sorted((r.k or "-", r.v) for r in refused) == [("-", 5), ("-", 6), ("a", 9)]


def test_a_new_checkpoint_takes_the_log_over(spark, tmp_path):
    put(spark, tmp_path, "1", [("a", 1), ("b", 2)])
    run(spark, tmp_path, "one")
    put(spark, tmp_path, "2", [("b", 2), ("c", 3), ("a", 7)])
    run(spark, tmp_path, "two", one_by_one=False)
    assert keys(spark, tmp_path) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted((r.k, r.v) for r in streaming.refused_rows(spark, str(tmp_path / "log")).collect()) == [("a", 7)]
    put(spark, tmp_path, "3", [("c", 3), ("d", 4)])
    run(spark, tmp_path, "two")
    assert keys(spark, tmp_path) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_a_key_with_most_rows(spark, tmp_path):
    spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("v")).write.parquet(str(tmp_path / "in" / "1"))
    run(spark, tmp_path, one_by_one=False)
    assert streaming.read_log(spark, str(tmp_path / "log")).count() == 20_000 - 6667 + 1
    assert streaming.refused_rows(spark, str(tmp_path / "log")).count() == 0


def test_own_columns(spark, tmp_path):
    put(spark, tmp_path, "1", [("a", 1)])
    stream = spark.readStream.schema("k string, batch int").parquet(str(tmp_path / "in" / "1"))
    with pytest.raises(ValueError, match="batch"):
        streaming.append_once(stream, "k", str(tmp_path / "log"), str(tmp_path / "cp"))
    assert not Path(tmp_path / "log").exists()
