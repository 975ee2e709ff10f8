"""Byte-exact removal of repeats by suffix order and longest previous factors.

Method.  The longest previous factor of a place is the longest string that
starts there and earlier too; in suffix order it is the longer of the common
prefixes with the previous and the next smaller position.  At a threshold only
this counts: suffixes that agree in ``depth`` symbols are a run in suffix
order, and within a run, ordered by place, the previous one is the smaller
position that gives the earlier match, the next one the later match
(``factors``).  A place without an earlier match holds a first copy.

Across documents one suffix order is cut into many.  A string of ``depth``
symbols contains the least of its hashed grams, wherever it stands (winnowing);
this anchor owns the string.  Anchors that occur once own no repeat.  An anchor
whose whole segment of text recurs owns repeats only.  What is left, one segment
for each kind, is cut into blocks of ``STARTS`` starts that are aligned with the
anchor.  The strings of a block have a core in common; a core that occurs once
holds no repeat.  Blocks of equal anchor, alignment and core are a bucket: their
strings differ in the flanks alone, ``STARTS - 1`` symbols on each side, so
a bucket is put into suffix order from its flanks.  A bucket of more than
``kinds`` different flanks is dealt anew in halves, whose cores are longer; a
block of one start is a string of its own and only counted.

Symbols are bytes, or words where passages of so many words are asked for.

Scale.  The shuffles carry 40 bytes for each 140 of text, the flanks of what
repeats in part, and the text of documents that have a repeat twice.  A bucket
has a bounded number of rows, equal flanks are one row, and each halving makes two
rows of one at most.  Equality is judged by symbols within flanks, and by two
64-bit hashes (of the anchor, and of core or segment) of what flanks enclose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import U, VISIBLE, Words, blobs, lists, prefix, prefix_of, raw, slices, span_hash, trimmed

DEPTH, GRAM = 400, 128
#: Passages of more than fifty words, and their grams.
PASSAGE, PASSAGE_GRAM = 51, 16
#: Starts of a block (a power of two), kinds of a bucket that is put into suffix order at once, rows of a batch of buckets.
STARTS, KINDS, HELD = 32, 8192, 1 << 17


def factors(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later): for each place the nearest place before and after it whose suffix has the same rank, or -1.

    Ranks tell suffixes apart by their first ``depth`` symbols only; ties stand
    in the order of their places, so that the previous entry of a run is the
    smaller position with the longest common prefix.
    """
    order = np.argsort(rank, kind="stable")
    same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
    earlier, later = np.full((2, len(rank)), -1)
    earlier[order[same + 1]] = order[same]
    later[order[same]] = order[same + 1]
    return earlier, later


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the rows of integer columns, each below 2 ** 32."""
    key = columns[0].astype(U)
    for c in columns[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(U) << U(32) | c.astype(U)
    return np.unique(key, return_inverse=True)[1]


def ranks(bucket: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(rows, starts) ranks of the strings left[o:] + core + right[:o] of each row, for every start o.

    As suffixes are sorted from the right: a start's left part is ranked by its
    first symbol and the rank of the rest, and its right part grows likewise.
    """
    rows, width = left.shape
    before, after = np.empty((2, width + 1, rows), np.int64)
    before[width], after[0] = bucket, 0
    for o in range(width - 1, -1, -1):
        before[o] = _numbered(before[o + 1], left[:, o])
    for o in range(width):
        after[o + 1] = _numbered(after[o], right[:, o])
    out = np.empty((width + 1, rows), np.int64)
    top = 0
    for o in range(width + 1):
        out[o] = _numbered(before[o], after[o]) + top
        top = int(out[o].max()) + 1 if rows else top
    return out.T


def _symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, prefix sums) of a batch of texts."""
    if words:
        w = Words(column, VISIBLE, lower=False)
        return w.hash, w.first, prefix_of(w.hash)
    data, offsets = raw(column)
    return data, offsets, prefix(data)


ANCHORS = "id long, g long, seg long, s long, k int, d int"


def _anchors(depth: int, gram: int, words: bool):
    width = depth - gram + 1

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, sums = _symbols(part.column("text"), words)
            n = len(data) - gram + 1
            if n < width:
                continue
            at = np.arange(n)
            grams = span_hash(sums, at, at + gram)
            low = (1 << max(24, int(n).bit_length())) - 1
            packed = (grams & U(~low & 0xFFFFFFFFFFFFFFFF)) | at.astype(U)
            # Minima of all runs of ``width`` grams: suffix minima of a block with prefix minima of the next.
            rows = -(-n // width)
            grid = np.full(rows * width, 0xFFFFFFFFFFFFFFFF, U)
            grid[:n] = packed
            grid = grid.reshape(rows, width)
            right = np.minimum.accumulate(grid, axis=1).ravel()
            left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            least = (np.minimum(left[: n - width + 1], right[width - 1 : n]) & U(low)).astype(np.int64)
            size = np.diff(offsets)
            some = np.flatnonzero(size >= depth)
            if not len(some):
                continue
            count = size[some] - depth + 1
            starts = np.repeat(offsets[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            doc = np.repeat(some, count)
            anchor = least[starts]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.append(first[1:], len(starts)) - 1
            s1, s2, p, d = starts[first], starts[last], anchor[first], doc[first]
            segment = span_hash(sums, s1, s2 + depth)
            yield pa.record_batch(
                [part.column("id").take(pa.array(d)), pa.array(grams[p].view(np.int64)), pa.array(segment.view(np.int64)), pa.array((s1 - offsets[d]).astype(np.int64)), pa.array((s2 - s1 + 1).astype(np.int32)), pa.array((p - s1).astype(np.int32))],
                ["id", "g", "seg", "s", "k", "d"],
            )

    return run


BLOCKS = "g long, b long, core long, id long, s long, lo int, hi int, left binary, right binary, many boolean"


def _cut(depth: int, starts: int, words: bool):
    """Blocks of the segments that a text comes with: cores as hashes, flanks as they are."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, sums = _symbols(part.column("text"), words)
            own = part.column("own")
            count = own.value_lengths().to_numpy(zero_copy_only=False)
            flat = own.flatten()
            g, s, k, d, many = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "s", "k", "d", "many"))
            doc = np.repeat(np.arange(len(own)), count)
            # Blocks by how far the anchor lies behind the start: from d - k + 1 to d.
            b0, b1 = (d - k + 1) // starts, d // starts
            blocks = b1 - b0 + 1
            row = np.repeat(np.arange(len(g)), blocks)
            b = np.repeat(b1, blocks) - (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            a = s[row] + d[row] - (b * starts + starts - 1)
            lo, hi = np.maximum(0, s[row] - a), np.minimum(starts, s[row] + k[row] - a)
            base, end = offsets[doc[row]], offsets[doc[row] + 1]
            inside = base + a + hi - 1 + depth <= end  # else of another text with this id
            row, b, a, lo, hi, base = (x[inside] for x in (row, b, a, lo, hi, base))
            if not len(row):
                continue
            core = span_hash(sums, base + a + starts - 1, base + a + depth)
            step = np.arange(starts - 1)
            left = data[np.clip((base + a)[:, None] + step, 0, len(data) - 1)] * (step >= lo[:, None])
            right = data[np.clip((base + a)[:, None] + depth + step, 0, len(data) - 1)] * (step < hi[:, None] - 1)
            sides = [blobs(np.full(len(row), x.shape[1] * x.itemsize), np.ascontiguousarray(x.astype(data.dtype)).view(np.uint8).ravel()) for x in (left, right)]
            yield pa.record_batch(
                [pa.array(g[row]), pa.array(b.astype(np.int64)), pa.array(core.view(np.int64)), part.column("id").take(pa.array(doc[row])), pa.array(a.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *sides, pa.array(many[row].astype(bool))],
                ["g", "b", "core", "id", "s", "lo", "hi", "left", "right", "many"],
            )

    return run


def _side(column: pa.Array, width: int, words: bool) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), U if words else np.uint8).reshape(len(column), width)
    return np.unique(data, return_inverse=True)[1].reshape(data.shape) if words else data


def _order(depth: int, starts: int, words: bool, kind: str):
    """Repeated runs of starts in buckets, whose kinds come one after another in the order of their places."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([t.column(c).to_numpy() for c in ("g", "b", "core")])
            bucket = np.cumsum(np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            left, right = (_side(t.column(c).combine_chunks(), starts - 1, words) for c in ("left", "right"))
            ids, s, lo, hi = (t.column(c).to_numpy() for c in ("id", "s", "lo", "hi"))
            many = t.column("many").to_numpy().astype(bool)
            o = np.arange(starts)
            own = (o >= lo[:, None]) & (o < hi[:, None])
            rank = _numbered(ranks(bucket, left, right)[own])
            row = np.nonzero(own)[0]
            earlier, later = factors(rank)
            if kind == "across":
                first, last = np.full((2, int(rank.max(initial=-1)) + 1), -1)
                first[rank[earlier < 0]], last[rank[later < 0]] = ids[row[earlier < 0]], ids[row[later < 0]]
                again = (first != last)[rank] | (np.bincount(rank, weights=many[row]) > 0)[rank]
            else:
                again = earlier >= 0
                if kind == "all":
                    again |= later >= 0
            found = np.zeros((len(ids), starts + 2), np.int8)
            found[:, 1:-1][own] = again
            step = np.diff(found, axis=1)
            r, begin = np.nonzero(step == 1)
            end = np.nonzero(step == -1)[1]
            return pa.record_batch([pa.array(ids[r]), pa.array(s[r] + begin), pa.array(s[r] + end - 1 + depth)], ["id", "s", "e"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if rows > HELD and batch.num_rows:
                table = pa.Table.from_batches(held)
                # What stands in the last bucket waits for the rest of it.
                same = np.ones(len(table), bool)
                for c in ("g", "b", "core"):
                    x = table.column(c).to_numpy()
                    same &= x == x[-1]
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield work(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = len(table) - cut
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield work(pa.Table.from_batches(held))

    return run


def _halves(rows: DataFrame, starts: int, unit: int) -> DataFrame:
    """Blocks of ``starts`` starts as blocks of half as many; what a half's strings have in common goes to its core."""
    half = starts // 2
    parts = []
    for h in (0, 1):
        part = lambda c, a, b: F.substring(F.col(c), a * unit + 1, (b - a) * unit)
        at = h * half
        lo, hi = F.greatest(F.lit(0), F.col("lo") - at), F.least(F.lit(half), F.col("hi") - at)
        parts.append(
            rows.where((F.col("lo") < at + half) & (F.col("hi") > at)).select(
                "g", (F.col("b") * 2 + h).alias("b"), F.xxhash64("core", part("left", at + half - 1, starts - 1), part("right", 0, at)).alias("core"), "id", (F.col("s") + at).alias("s"),
                lo.alias("lo"), hi.alias("hi"), part("left", at, at + half - 1).alias("left"), part("right", at, at + half - 1).alias("right"), "many",
            )
        )
    return parts[0].unionByName(parts[1])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, kind: str = "all", words: bool = False, starts: int = STARTS, kinds: int = KINDS) -> DataFrame:
    """(id, s, e) ranges of symbols, end excluded, of strings of ``depth`` symbols that occur more than once; ranges may overlap.

    ``kind`` "all": of all of them; "later": of those with an earlier match by
    (id, place), so that first copies stay; "across": some of a document's
    strings that stand in another document too, for each document that has one.
    Symbols are bytes, or with ``words`` the words ``[^\\x20\\x09-\\x0D]+`` as
    written.  Rows of a null id have no range.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    anchors = scratch.write(text.mapInArrow(_anchors(depth, gram, words), ANCHORS), "anchors")
    across, unit = kind == "across", 8 if words else 1
    # Of a document that holds a string more than once, one place does for what other documents have of it.
    several = F.min("id") < F.max("id") if across else F.count("*") > 1
    often = anchors.groupBy("g").agg(several.alias("several")).where("several").select("g")
    shared = scratch.write(anchors.join(often, "g", "left_semi"), "shared")
    scratch.release()
    scratch.drop("anchors")
    one = F.min(F.struct("id", "s", "k", "d")).alias("one")
    classes = scratch.write(shared.groupBy("g", "seg").agg(several.alias("many"), one), "classes")
    groups = classes.groupBy("g").agg(F.count("*").alias("kinds"), F.count_if(~F.col("many")).alias("single")).where("kinds > 1" if kind == "later" else "kinds > 1 and single > 0")
    need = classes.join(groups, "g").select("g", "one.*", "many")
    per = need.groupBy("id").agg(F.collect_list(F.struct("g", "s", "k", "d", "many")).alias("own"))
    blocks = scratch.write(text.join(per, "id").mapInArrow(_cut(depth, starts, words), BLOCKS), "blocks")
    scratch.release()
    span = (F.col("id"), (F.col("s") + F.col("lo")).alias("s"), (F.col("s") + F.col("hi") - 1 + depth).alias("e"))
    whole = shared.join(classes.where("many").select("g", "seg", F.col("one.id").alias("id1"), F.col("one.s").alias("s1")), ["g", "seg"])
    if kind == "later":
        whole = whole.where("id <> id1 or s <> s1")
    found = [whole.select("id", "s", (F.col("s") + F.col("k") - 1 + depth).alias("e"))]
    bucket, level = ["g", "b", "core"], 0
    while True:
        # Cores that occur once hold no repeat; equal flanks are one kind.
        often = blocks.groupBy(*bucket).agg((F.count("*") > 1).alias("several")).where("several").select(*bucket)
        flanks = [*bucket, "lo", "hi", "left", "right"]
        alive = blocks.join(often, bucket, "left_semi")
        kept = alive.groupBy(*flanks).agg(several.alias("equal"), F.max("many").alias("many"), F.min(F.struct("id", "s")).alias("one"))
        kept = scratch.write(kept.select(*flanks, "equal", F.col("one.id").alias("id"), F.col("one.s").alias("s"), (F.col("many") | F.col("equal")).alias("many")), f"kinds{level}")
        equal = blocks.join(kept.where("equal").select(*flanks, F.col("id").alias("id1"), F.col("s").alias("s1")), flanks)
        if kind == "later":
            equal = equal.where("id <> id1 or s <> s1")
        found.append(equal.select(*span))
        if starts == 1:
            break
        sizes = kept.groupBy(*bucket).agg(F.count("*").alias("m"), F.count_if(~F.col("many")).alias("single")).where("m > 1" if kind == "later" else "m > 1 and single > 0")
        sizes = scratch.write(sizes.select(*bucket, "m"), f"sizes{level}")
        small = kept.join(sizes.where(F.col("m") <= kinds), bucket)
        found.append(small.repartition(*bucket).sortWithinPartitions(*bucket, "id", "s").select("g", "b", "core", "id", "s", "lo", "hi", "left", "right", "many").mapInArrow(_order(depth, starts, words, kind), "id long, s long, e long"))
        large = sizes.where(F.col("m") > kinds)
        if large.isEmpty():
            break
        blocks = scratch.write(_halves(kept.join(large.select(*bucket), bucket, "left_semi"), starts, unit), f"blocks{level + 1}")
        starts, level = starts // 2, level + 1
        scratch.release()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = scratch.write(out.distinct() if across else out, "spans")
    scratch.release()
    for name in ("shared", "classes", "blocks", *(f"{n}{i}" for i in range(level + 1) for n in ("kinds", "sizes", "blocks"))):
        scratch.drop(name)
    return out


def merged(spans: DataFrame) -> DataFrame:
    """Maximal runs of (id, s, e) ranges that touch or overlap."""
    order = W.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


REMOVED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<s: long, e: long>>"


@trimmed
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        data, offsets = raw(part.column("text"))
        spans = part.column("spans")
        count = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = spans.flatten()
        doc = np.repeat(np.arange(len(count)), count)
        base, end = offsets[doc], offsets[doc + 1]
        a, b = (np.minimum(base + flat.field(c).to_numpy(zero_copy_only=False), end) for c in ("s", "e"))
        some = a < b
        order = np.argsort(a[some], kind="stable")
        a, b, doc = a[some][order], b[some][order], doc[some][order]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[a] += 1
        np.subtract.at(edge, b, 1)  # a run may begin where that of the text before ends
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        left, at = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        hashes = [hashlib.sha256(left[i:j].tobytes()).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        size, runs = np.diff(offsets), np.bincount(doc, minlength=len(count))
        places = pa.StructArray.from_arrays([pa.array(x - offsets[doc]) for x in (a, b)], ["s", "e"])
        yield pa.record_batch([part.column("id"), pa.array(size), pa.array(size - np.diff(at)), pa.array(runs), pa.array(hashes, pa.string()), lists(runs, places)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, kind: str = "all", starts: int = STARTS, kinds: int = KINDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, runs) of every row: what is left without repeated strings.

    Each byte that a string of ``depth`` bytes covers which also starts anywhere
    else, in the same text or another, is removed; strings are judged on the
    input.  With ``kind`` "later" the first copy of a string, by (id, place),
    stays.  ``runs`` are the removed (s, e) byte ranges.

    Null texts are empty; texts of fewer bytes than ``depth`` stay whole; very
    long ones are taken whole.  Copies, ties and repeated rows: with "all" every
    copy is removed, the first too, and rows that repeat an id and text are
    copies of each other; with "later" they count as one.  Rows that share an id and
    differ in text have one set of ranges, that of both texts.  A null id keeps
    its text whole.  An empty table gives an empty result; other columns are not read.
    """
    spans = merged(repeats(docs, id_col, text_col, depth, gram, kind, False, starts, kinds)).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return text.join(spans, "id", "left").mapInArrow(_remove, REMOVED).withColumnRenamed("id", id_col)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, **options: object) -> DataFrame:
    """(id, s, e) maximal byte ranges of repeated strings that aren't first: the first copy of a string, by (id, place), stays."""
    return merged(repeats(docs, id_col, text_col, depth, kind="later", **options))


def sharing_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = PASSAGE_GRAM, **options: object) -> DataFrame:
    """(id), under the name of ``id_col``, of the documents with a string of ``passage`` words, as written, that stands in another document too."""
    return repeats(docs, id_col, text_col, passage, gram, "across", True, **options).select(F.col("id").alias(id_col)).distinct()
