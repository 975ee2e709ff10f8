"""Exact deduplication by two passes over digests and a Bloom filter of cells that were met twice.

The first pass fills the filter: every row sets PROBES cells of BITS cells a row,
and what is kept is whether a cell was set once or more often.  Tasks fill their
own part and only send which cells they have set.  A text that comes twice has
set all its cells twice.  The second pass asks the filter: rows of which a cell
was set once are alone and pass straight through; the rest, true repeats and six in
a thousand others ((1 - exp(-PROBES / BITS)) ^ PROBES), are shuffled and grouped by
their whole digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..operators.hot import lookup
from .scratch import Scratch
from .words import LOWER, raw, slices, trimmed

BITS, PROBES = 12, 4
#: Cells of a chunk of the filter, and of the largest filter that is sent to tasks at once (128 MB).
CHUNK, MOST = 1 << 15, 1 << 30


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows, "text"):
        data, at = raw(batch.column("text"))
        view, at = memoryview(LOWER[data]), at.tolist()
        sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), *(batch.column(c) for c in others)], ["sha", *others])


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """(sha, id): SHA-256 of each whole text with A-Z lower-cased; null is the empty text.  With ``whole`` also the row itself, as ``row``."""
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []))
    return rows.mapInArrow(trimmed(_digests), StructType([StructField("sha", BinaryType()), *(f for f in rows.schema if f.name != "text")]))


def _probes(sha: pa.Array, cells: int) -> np.ndarray:
    """A row of PROBES cells for each digest."""
    data, _ = raw(sha)
    return (data.reshape(-1, 32)[:, : 8 * PROBES].copy().view("<u8") % np.uint64(cells)).astype(np.int64)


def _filled(cells: int):
    """Cells that a task's rows set once and more than once, by chunk."""

    def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds the cells of a run of rows, whatever the partition's size.
        held, n = [], 0
        for batch in rows:
            if batch.num_rows:
                held.append(_probes(batch.column("sha"), cells).ravel())
                n += len(held[-1])
            if n >= 1 << 23:
                yield from _sent(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from _sent(np.concatenate(held))

    return trimmed(fill)


def _sent(cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    cell, times = np.unique(cell, return_counts=True)
    chunk, place = cell // CHUNK, (cell % CHUNK).astype("<u2")
    starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    ends = np.append(starts[1:], len(cell))
    once = [place[a:b][times[a:b] == 1].tobytes() for a, b in zip(starts, ends, strict=True)]
    often = [place[a:b][times[a:b] > 1].tobytes() for a, b in zip(starts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(chunk[starts].astype(np.int32)), pa.array(once, pa.binary()), pa.array(often, pa.binary())], ["chunk", "once", "often"])


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, whose rows follow one another, a bit for each cell that was set more than once."""
    now, seen, bits = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in rows:
        for chunk, once, often in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "often")), strict=True):
            if chunk != now:
                if now is not None and bits.any():
                    yield out()
                now, seen, bits = chunk, np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
            once, often = np.frombuffer(once, "<u2"), np.frombuffer(often, "<u2")
            bits[once[seen[once]]] = True
            bits[often] = True
            seen[once] = True
            seen[often] = True
    if now is not None and bits.any():
        yield out()


def _filter(rows: DataFrame, cells: int) -> np.ndarray:
    """The bits of all cells that ``rows`` have set more than once: at most ``cells`` bits come to the driver."""
    sent = rows.select("sha").mapInArrow(_filled(cells), "chunk int, once binary, often binary")
    merged = sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk int, bits binary").toArrow()
    bits = np.zeros((-(-cells // CHUNK), CHUNK // 8), np.uint8)
    if merged.num_rows:
        bits[merged.column("chunk").to_numpy()] = raw(merged.column("bits"))[0].reshape(-1, CHUNK // 8)
    return bits.ravel()


def _asked(bits, cells: int):
    """Which rows may be repeated."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                at = _probes(batch.column("sha"), cells)
                met = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                yield batch.append_column("maybe", pa.array(met.all(axis=1)))

    return ask


def asked(rows: DataFrame, scratch: Scratch, n: int, most: int = MOST) -> DataFrame:
    """``rows`` (sha and others), written, with ``maybe``, false only where no other row has the digest, and ``at``, a row's number.

    ``n`` is how many rows there are.  A filter of more than ``most`` cells is made
    and asked in blocks of the digests, one after the other, each over its own files.
    """
    spark, blocks = rows.sparkSession, max(1, -(-n * BITS // most))
    cells = -(-max(1, n // blocks) * BITS // CHUNK) * CHUNK
    block = (F.conv(F.hex(F.substring("sha", 29, 4)), 16, 10).cast("long") % blocks).cast("int").alias("block")
    rows.select("*", block).write.partitionBy("block").parquet(f"{scratch.path}/digests")
    kept = spark.read.schema(StructType([*rows.schema, StructField("block", IntegerType())])).parquet(f"{scratch.path}/digests")
    schema = StructType([*rows.schema, StructField("maybe", BooleanType())])
    for b in range(blocks):
        own = kept.where(F.col("block") == b).drop("block")
        sent = spark.sparkContext.broadcast(_filter(own, cells))
        own.mapInArrow(_asked(sent, cells), schema).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{scratch.path}/asked/block={b}")
        sent.destroy()
    return spark.read.schema(StructType([*schema, StructField("at", LongType())])).parquet(*(f"{scratch.path}/asked/block={b}" for b in range(blocks)))


def _settled(docs: DataFrame, text: str, id_col: str, whole: bool, most: int) -> DataFrame:
    """Every row with its digest, its group's ``keep`` and ``size``, and whether it is the one that stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = asked(digests(docs, text, id_col, whole), scratch, docs.count(), most)
    others = ["sha", "id", *(["row"] if whole else [])]
    alone = rows.where("not maybe").select(*others, F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    some = rows.where("maybe")
    # The largest id, and of rows that share it one; rows of one digest are in one block, where ``at`` tells them apart.
    groups = some.groupBy("sha").agg(F.max(F.struct("id", "at")).alias("top"), F.count("*").alias("size"), F.count("*").alias("of"))
    groups = scratch.write(groups, "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    met = lookup(some, groups, ["sha"], "of", total)
    return alone.unionByName(met.select(*others, F.col("top.id").alias("keep"), "size", (F.col("at") == F.col("top.at")).alias("kept")))


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: which row of its equal texts stays.

    Texts are equal when they are identical after lower-casing A-Z alone; equality is
    that of SHA-256.  The row of the largest id stays.  Null and empty texts are one
    group.  A null id is less than any other; of rows that share text and id, all
    without an id too, one stays, and all count.  Other columns don't matter.
    An empty table gives an empty table.
    """
    out = _settled(docs, text, id_col, False, most)
    return out.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """The rows that stay, with all their columns; rows met once never leave the files that their task wrote."""
    return _settled(docs, text, id_col, True, most).where("kept").select("row.*")
