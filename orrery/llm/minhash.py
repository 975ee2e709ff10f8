"""MinHash near-duplicates: one-permutation hashing, banded buckets, star edges.

Method.  A text's set is its distinct word shingles.  ``groups`` independent
one-permutation hashes each throw the set into ``bins`` bins and keep the
least value of a bin; an empty bin borrows from a bin drawn by the optimal
densification of one-permutation hashing (the draw depends on the empty bin
and the attempt alone, so equal sets borrow alike).  ``rows`` neighbouring
values of a group make a band.  Texts with equal sets are one class first and
only its smallest id goes on, so thousands of exact copies cost one row.
Classes that share a band share a bucket, and each bucket links its members to
one hub only, which keeps candidate pairs linear in the input.  Buckets that
then hold several components are open: all pairs of their members that are in
different components are compared by whole sets, so that every pair that
shares a band is either in one component or was compared.  The hubs'
candidates pass a test of sizes (exact), a test of the whole signature
(``screen``, some five standard deviations below the threshold) and then the
exact test on the full sets.

Scale.  Every shuffle moves ids and 64-bit keys, but for the sets of candidates
and of members of open buckets; texts are read three times (for signatures, and
for those sets) and never shuffled.  Open buckets that share members are one
unit up to ``UNIT`` members, so that a set isn't sent once for each band; a unit
is dealt in blocks, each pair of blocks is one group, and its answer is a forest.
The work on a hot template grows with the square of its texts that no hub
linked.  Nothing is collected but counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import U, VISIBLE, Words, blobs, lists, mix, shingle_sets, slices, trimmed

GROUPS, BINS, ROWS = 8, 24, 4
#: Groups whose values make bands; all groups make the signature that screens pairs.
BANDED = 4
SCREEN = 0.6
#: Members of a unit of open buckets; above it each bucket is a unit.  Members and shingles of a block, on average.
UNIT, BLOCK, BLOCK_SHINGLES = 16_384, 512, 1 << 19
#: Columns of a slice of the matrix of shingles, and members up to which a shingle's pairs are listed.
COLUMNS, LISTED = 4096, 4


def _densify(values: np.ndarray) -> np.ndarray:
    """Fill each empty bin (all ones) of a row from the bin that its own sequence of draws first finds filled."""
    n, bins = values.shape
    filled = values != np.uint32(0xFFFFFFFF)
    row, bin_ = np.nonzero(~filled)
    todo, attempt = np.arange(len(row)), 0
    source = np.empty(len(row), np.int64)
    while len(todo):
        draw = (mix(bin_[todo].astype(U) * U(0x9E3779B97F4A7C15) + U(attempt * 2 + 1)) % U(bins)).astype(np.int64)
        found = filled[row[todo], draw]
        source[todo[found]] = draw[found]
        todo, attempt = todo[~found], attempt + 1
    out = values.copy()
    out[row, bin_] = values[row, source]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, GROUPS * BINS) minima as unsigned 32-bit integers; no set may be empty."""
    sizes = np.array([len(s) for s in sets])
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.empty((len(sets), GROUPS, BINS), np.uint32)
    for g in range(GROUPS):
        h = mix(shingles ^ U(0xA0761D6478BD642F * (g + 1) & 0xFFFFFFFFFFFFFFFF))
        bin_ = ((h >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
        least = np.full(len(sets) * BINS, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, owner * BINS + bin_, np.minimum(h & U(0xFFFFFFFF), U(0xFFFFFFFE)).astype(np.uint32))
        out[:, g] = _densify(least.reshape(len(sets), BINS))
    return out.reshape(len(sets), GROUPS * BINS)


def bands(signature: np.ndarray) -> np.ndarray:
    """(texts, bands) 64-bit bucket keys."""
    n, width = signature.shape
    parts = signature.reshape(n, width // ROWS, ROWS).astype(U)
    keys = np.zeros(parts.shape[:2], U)
    for j in range(ROWS):
        keys = mix(keys * U(0x9FB21C651E98DF25) + parts[:, :, j])
    return mix(keys + np.arange(width // ROWS, dtype=U)[None, :] * U(0xD6E8FEB86659FD93))


def _sign(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = list(shingle_sets(Words(part.column("text"), VISIBLE), size))
            n = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            full = n > 0
            key = np.zeros((len(sets), 2), U)
            if some:
                key[full] = [(s.sum(dtype=U), mix(s).sum(dtype=U)) for s in some]
            found = signatures(some) if some else np.zeros((0, GROUPS * BINS), np.uint32)
            sig = blobs(full * found.shape[1], (found & np.uint32(255)).astype(np.uint8).ravel())
            banded = bands(found[:, : BANDED * BINS])
            keys = lists(full * banded.shape[1], banded.view(np.int64).ravel())
            key = key.view(np.int64)
            yield pa.record_batch(
                [part.column("id"), pa.array(n), pa.array(key[:, 0]), pa.array(key[:, 1]), sig, keys],
                ["id", "n", "k1", "k2", "sig", "bands"],
            )

    return run


def _sets(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = list(shingle_sets(Words(part.column("text"), VISIBLE), size))
            yield pa.record_batch([part.column("id"), lists(np.array([len(s) for s in sets]), np.concatenate(sets).view(np.int64))], ["id", "s"])

    return run


@trimmed
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            keep = (x == y).mean(axis=1) >= SCREEN
            yield pa.record_batch([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) numbers of common shingles of the sets at these places."""
    sizes = np.array([len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    at = np.full((2, len(sets)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    first = np.cumsum(held) - held
    for many in range(2, LISTED + 1):
        own = row[order[first[held == many][:, None] + np.arange(many)]]
        for i in range(many):
            for j in range(many):
                a, b = at[0, own[:, i]], at[1, own[:, j]]
                fits = (a >= 0) & (b >= 0) & (own[:, i] != own[:, j])
                out += np.bincount(a[fits] * len(right) + b[fits], minlength=out.size).reshape(out.shape)
    heavy = np.flatnonzero(held > LISTED)
    for k in range(0, len(heavy), COLUMNS):
        some = heavy[k : k + COLUMNS]
        span = np.concatenate([order[first[c] : first[c] + held[c]] for c in some])
        where = np.repeat(np.arange(len(some)), held[some])
        block = np.zeros((len(sets), len(some)), np.float32)
        block[row[span], where] = 1
        out += block[left] @ block[right].T
    return out


def forest(pairs: np.ndarray, labels: np.ndarray) -> list[int]:
    """Places of the pairs that join what labels and the pairs before didn't."""
    parent = np.unique(labels, return_inverse=True)[1].tolist()
    ends = parent.copy()
    parent = list(range(max(parent, default=-1) + 1))
    out = []
    for k, (a, b) in enumerate(pairs.tolist()):
        x, y = ends[a], ends[b]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _compare(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, c, at = (table.column(n).to_numpy() for n in ("id", "c", "at"))
        n = pc.list_value_length(table.column("s")).to_numpy()
        flat = table.column("s").combine_chunks().flatten().to_numpy().view(U)
        sets = np.split(flat, np.cumsum(n)[:-1])
        left, right = np.flatnonzero(at == key[1].as_py()), np.flatnonzero(at == key[2].as_py())
        if not len(left) or not len(right):
            return table.select(["id", "c"]).slice(0, 0).rename_columns(["a", "b"])
        common = overlaps(sets, left, right)
        fits = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (c[left][:, None] != c[right][None, :])
        x, y = np.nonzero(fits)
        pairs = np.stack([left[x], right[y]], axis=1)
        pairs = pairs[forest(pairs, c)]
        a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _units(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, i, j, at, id, c): the members of open buckets by pair of blocks; ``at`` is the member's block, i or j."""
    keyed = rows.groupBy("key").agg(F.min("id").alias("hub"))
    whole = components(rows.join(keyed, "key").select("id", "hub"), scratch, "id", "hub").withColumnRenamed("component", "whole")
    whole = scratch.write(whole.join(whole.groupBy("whole").agg(F.count("*").alias("m")), "whole"), "wholes")
    rows = rows.join(whole, "id")
    small = F.col("m") <= UNIT
    rows = rows.select(F.when(small, F.xxhash64("whole")).otherwise(F.col("key")).alias("unit"), "id", "c", "n").distinct()
    rows = scratch.write(rows, "units")
    # The component with most members isn't compared with itself: the rest is dealt to the first blocks, it to those after them.
    parts = rows.groupBy("unit", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    of = parts.groupBy("unit").agg(F.max(F.struct("m", "w", "c")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    of = of.select("unit", F.col("top.c").alias("top"), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("r"), blocks(F.col("top.m"), F.col("top.w")).alias("g"))
    rows = rows.join(of, "unit")
    is_top = F.col("c") == F.col("top")
    at = F.when(is_top, F.col("r") + F.pmod(F.xxhash64("id"), F.col("g"))).otherwise(F.pmod(F.xxhash64("id"), F.col("r"))).cast("int")
    rows = rows.withColumn("at", at)
    other = F.explode(F.sequence(F.lit(0), F.when(is_top, F.col("r")).otherwise(F.col("r") + F.col("g")) - 1))
    rows = rows.select("unit", "at", "id", "c", other.alias("other"))
    return rows.select("unit", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "c")


def _screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    sig = reps.select("id", "sig")
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return pairs.mapInArrow(_alike, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text, shingles
    ``size`` consecutive words.  Rows are linked when
    ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest id
    reachable, ``kept`` says that it is the row's own.

    Null and blank texts have an empty set (``n_shingles`` 0), are linked with
    nothing and kept.  Texts of fewer words than ``size`` have one shingle,
    their whole sequence.  Ties and repeated rows: equal sets are always one
    component; rows that repeat an id count as one id.  Columns other than the
    two named are not read, so their names don't matter.  An empty table gives
    an empty result.  Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.write(text.mapInArrow(_sign(size), "id long, n long, k1 long, k2 long, sig binary, bands array<long>"), "signed")

    # One class for each distinct set; the smallest id stands for it.
    classes = scratch.write(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.join(classes.select("k1", "k2", F.col("rep").alias("id"), "copies"), ["k1", "k2", "id"]).dropDuplicates(["id"])
    reps = scratch.write(reps.select("id", "n", "copies", "sig", "bands"), "reps")
    member = reps.select(F.posexplode("bands").alias("band", "key"), "id", "n", "copies")
    hub = F.min(F.struct(F.xxhash64("id").alias("r"), F.col("id").alias("hub"), F.col("n").alias("hub_n"))).alias("h")
    hubs = member.groupBy("key").agg(hub, F.count("*").alias("m")).where("m > 1")
    # What shares a bucket at all; the rest of the operator reads this small part only.
    shared = scratch.write(member.join(hubs.select("key", "m", "h.hub", "h.hub_n"), "key"), "shared")
    scratch.release()
    fits = f"id <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    star = shared.where(fits)
    pairs = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    pairs = scratch.write(_screened(pairs, reps), "pairs")
    # As a table its size is known: where it is small the texts are not shuffled to meet it.
    ends = scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ends")
    sets = scratch.write(text.join(ends, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(size), "id long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = scratch.write(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    comp = scratch.write(components(links, scratch), "comp")
    scratch.release()
    # Buckets of two are settled, and those of one component.
    rows = shared.where("m > 2").join(comp, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    split = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    opened = scratch.write(rows.join(split.select("key"), "key", "left_semi"), "open")
    if not opened.isEmpty():
        dealt = scratch.write(_units(opened, scratch), "dealt")
        more = scratch.write(opened.select("id").distinct().join(ends, "id", "left_anti"), "more")
        rest = scratch.write(text.join(more, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(size), "id long, s array<long>"), "rest")
        met = dealt.join(sets.unionByName(rest), "id").groupBy("unit", "i", "j").applyInArrow(_compare(percent), "a long, b long")
        found = scratch.write(met, "found")
        if not found.isEmpty():
            comp = scratch.write(components(links.unionByName(found), scratch), "comp2")
        scratch.release()
    whole = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
