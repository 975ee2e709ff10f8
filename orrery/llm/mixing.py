"""Mixing sources to target weights by Sainte-Laguë apportionment.

Method.  Targets share all words by the sources' weights; a target stops at
``cap`` times its source's size and the excess is shared again (water filling,
in closed form over the sources ordered by cap to weight).  The words to take
are cut into equal blocks of ``block`` words, and blocks go to sources by the
highest quotients target / (2 s + 1).  A source's documents are dealt to
shards by a seeded hash; its blocks go to its shards by the same rule with the
shards' sizes.  A shard is one stream of words in a seeded order of documents,
cut into n equal blocks; a quota of q blocks takes every block q div n times
and q mod n blocks, drawn by a seeded stride, once more.

Scale.  Texts are read once, to count words; what is shuffled is an id, a
source, a size and a hash for each row.  A source has about the square root of
its blocks as shards, so a source with a third of all rows is thousands of
window partitions, and the tables of sources and of a source's shards stay
small.  Only candidates near the quota are ranked by quotient: some three for
each source or shard, not one for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import VISIBLE, raw, slices, spans, trimmed

BLOCK, CAP, SEED = 64, 3, "mix-1"
#: Strides of the block draw: primes, so that they and a shard's block count have no common factor but the prime itself.
STRIDES = (1_000_003, 15_485_863, 32_452_843, 49_979_687, 67_867_967)


def _number(digest: Column, start: int = 1) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def sainte_lague(of: DataFrame, key: str, weight: str, seats: str, group: list[str]) -> DataFrame:
    """``of`` with ``quota``: how many of a group's ``seats`` the row gets by highest quotients weight / (2 s + 1).

    All rows of a group carry the same ``seats``.  The rule's quotas lie within
    1 + share * rows of the exact share, so only quotients in that band are
    ranked; those below it are given.  Equal quotients go by ``key``, null last.
    """
    w = W.partitionBy(*group)
    exact = F.when(F.col("_sum") > 0, F.col(seats) * (F.col(weight) / F.col("_sum"))).otherwise(0.0)
    slack = F.when(F.col("_sum") > 0, F.ceil(F.col("_rows") * (F.col(weight) / F.col("_sum")))).otherwise(0) + 1
    banded = (
        of.withColumns({"_sum": F.sum(F.col(weight)).over(w), "_rows": F.count("*").over(w)})
        .withColumns({"_lo": F.greatest(F.lit(0), F.floor(exact) - slack).cast("long"), "_hi": (F.floor(exact) + slack + 1).cast("long")})
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    )
    ranked = banded.select("*", F.explode(F.sequence("_lo", "_hi")).alias("_s")).withColumn(
        "_rank", F.row_number().over(w.orderBy((F.col(weight) / (2 * F.col("_s") + 1)).desc(), F.col(key).asc_nulls_last(), "_s"))
    )
    won = F.count_if((F.col("_rank") <= F.col("_left")) & (F.col(weight) > 0))
    return ranked.groupBy(*of.columns, "_lo").agg(won.alias("_won")).withColumn("quota", F.col("_lo") + F.col("_won")).drop("_lo", "_won")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size) with ``weight`` and ``target``; the table has one row for each source."""
    everything = W.partitionBy(F.lit(1))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    fill = W.partitionBy(F.lit(1)).orderBy("_ratio", F.col("source").asc_nulls_last())
    out = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    out = out.withColumns({"_ratio": cap * F.col("source_size") / F.col("weight"), "_all": F.sum("source_size").over(everything)})
    out = out.withColumns({
        "_capped": F.coalesce(F.sum(cap * F.col("source_size")).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_weights": F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("_all") - F.col("_capped")) / F.col("_weights")
    out = out.withColumn("_level", F.first(F.when(level <= F.col("_ratio"), level), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return out.select("source", "source_size", "weight", F.least((cap * F.col("source_size")).cast("double"), F.coalesce("_level", F.lit(0.0)) * F.col("weight")).alias("target"), F.col("_all").alias("all_size"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, ...) of every row of ``docs``; further columns say which words.

    A size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text.  ``taken``
    counts the words the mix takes, repeats included, at most ``cap`` times the
    size.  Rows (of any columns) that are equal in id, source and size are
    interchangeable.  Null and blank texts have size 0 and are never taken;
    a null source is a source, ordered last; ids may be null or repeat.  An
    empty table gives an empty result; columns not named are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = sized.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    sized = scratch.write(sized, "sized")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    blocks = F.round(F.col("source_size") / block).cast("long")
    goal = goal.withColumn("_seats", F.round(F.col("all_size") / block).cast("long"))
    goal = sainte_lague(goal, "source", "target", "_seats", ["_seats"])
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sqrt(blocks) / 4)).cast("long"))
    goal = scratch.write(goal.select("source", "source_size", "target", "quota", "shards"), "sources")

    # One row for each source: sent to all tasks only where Spark's own size check allows.
    dealt = sized.join(goal, sized.source.eqNullSafe(goal.source), "inner").drop(goal.source)
    dealt = dealt.withColumn("shard", _number(F.col("h")) % F.col("shards"))
    shards = dealt.groupBy("source", "quota", "shard").agg(F.sum("size").alias("shard_size")).withColumnRenamed("quota", "source_quota")
    shards = sainte_lague(shards, "shard", "shard_size", "source_quota", ["source", "source_quota"])
    n = F.greatest(F.lit(1), F.round(F.col("shard_size") / block)).cast("long")
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    shards = shards.withColumn("n", n).select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "shard_size", "n",
        F.least("quota", cap * F.col("n")).alias("q"),
        F.element_at(F.array(*map(F.lit, STRIDES)), (_number(drawn) % len(STRIDES) + 1).cast("int")).cast("long").alias("stride"),
        _number(drawn, 9).alias("shift"),
    )
    shards = scratch.write(shards, "shards")
    stream = W.partitionBy("source", "shard").orderBy("h", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(stream)).withColumn("start", F.col("upto") - F.col("size"))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")), "inner")
    extra = F.expr(
        "aggregate(sequence(((start + 1) * n - 1) div shard_size, (upto * n - 1) div shard_size), 0L, (a, j) -> a + "
        "if((j * stride + shift) % n < q % n, least((j + 1) * shard_size div n, upto) - greatest(j * shard_size div n, start), 0L))"
    )
    taken = F.when(F.col("size") > 0, F.expr("q div n") * F.col("size") + extra).otherwise(F.lit(0).cast("long"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "source", "start", "shard_size", "n", "q", "stride", "shift")


def copies(size: int, start: int, shard_size: int, n: int, q: int, stride: int, shift: int) -> list[tuple[int, int, int]]:
    """(copy, first word, end word) runs that a document of ``size`` words at ``start`` of its shard's stream gives to the mix."""
    out: list[tuple[int, int, int]] = []
    base, more = divmod(q, n)
    out += [(c, 0, size) for c in range(base)]
    for j in range(((start + 1) * n - 1) // shard_size, ((start + size) * n - 1) // shard_size + 1) if size else ():
        if (j * stride + shift) % n < more:
            a, b = max(j * shard_size // n, start) - start, min((j + 1) * shard_size // n, start + size) - start
            if len(out) > base and out[-1][2] == a:
                out[-1] = (base, out[-1][1], b)
            else:
                out.append((base, a, b))
    return out


@trimmed
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["size", "start", "shard_size", "n", "q", "stride", "shift"]
    for part in slices(batches, "text"):
        data, offsets = raw(part.column("text"))
        start, end, first = spans(data, offsets, VISIBLE)
        row, text = [], []
        for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in names), strict=True)):
            by: dict[int, list[bytes]] = {}
            for c, a, b in copies(*values):
                whole = (a, b) == (0, values[0])
                lo, hi = (offsets[i], offsets[i + 1]) if whole else (start[first[i] + a], end[first[i] + b - 1])
                by.setdefault(c, []).append(data[lo:hi].tobytes())
            row += [i] * len(by)
            text += [b"\n".join(x).decode() for _, x in sorted(by.items())]
        kept = part.take(pa.array(row, pa.int64()))
        yield kept.set_column(kept.schema.get_field_index("text"), "text", pa.array(text, pa.string())).drop_columns(names)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy of a document, with the words that the copy gives.

    A whole copy keeps its text as it is; of a partly taken one the runs of
    words taken are joined by a line break.  Documents that give no word (null,
    empty and blank texts among them) go; the result repeats the id of a document
    taken more than once.  Where ids repeat or are null, rows are numbered first, as
    they stand, and mixed by number.  Nulls in other columns stay as they are, and any
    column names will do; an empty table gives an empty one.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("i")).count()
    if not ids.where("i is null or count > 1").isEmpty():
        scratch = Scratch(docs.sparkSession, "numbered")
        # Written once, so that a row keeps its number.
        rows = scratch.write(docs.select(F.struct(*docs.columns).alias("row")).withColumn("number", F.monotonically_increasing_id()), "rows")
        named = rows.select("number", F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"), "row")
        out = mixed(named, "number", "text", "source", **options)
        return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    # The text is not shuffled with the plan's windows: the plan's few numbers are joined to it.
    names = ("size", "start", "shard_size", "n", "q", "stride", "shift")
    chosen = plan(docs, id_col, text_col, source_col, **options).where("taken > 0").select(F.col(id_col).cast("long").alias("mix_id"), *names)
    # The other columns travel in a struct, so that their names can be any.
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.col(id_col).cast("long").alias("mix_id"), F.struct(*others).alias("rest"), F.col(text_col).alias("text"))
    flat = packed.join(chosen, "mix_id").drop("mix_id")
    schema = flat.select("rest", "text").schema
    out = flat.mapInArrow(_texts, schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))
