"""Embedding near-duplicates by E8 lattice hashing.

Method.  A unit vector is projected to eight dimensions in each of ``tables``
random rotations and decoded to the nearest point of the E8 lattice (the
better of D8 and D8 + 1/2).  Every vector is indexed under its own cell; it
looks in its own cell and in the ``probes`` neighbouring cells, of the 240
minimal vectors, that are nearest to it.  Pairs that meet are verified by
cosine in double precision.  Where there are so many vectors of a label that
chance meetings would dominate, a key joins the points of several rotations,
and there are more tables.

Recall.  A pair at cosine 0.98 meets in one table with a probability of about
0.96 (look-ups go both ways), so five tables miss one in some 10^7.  With keys
of two rotations it is 0.45 to 0.47 and 25 tables, with three 0.18 to 0.19 and
75 (simulated, 8 to 128 dimensions), so fewer than one in 10^6 are missed at any
size.

Scale.  Exact copies are one row first, so that thousands of copies cost one
vector and are counted by number.  The shuffles carry keys and ids; vectors
follow only for candidate pairs.  Keys hold the label, and a dense group is
spread over the cells of all tables.  Links between different vectors of one
dense group are what the result counts, so those pairs are verified all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import U, lists, mix, trimmed

TABLES, PROBES, SPREAD = 5, 8, 1.0
#: Vectors of one label from which on a key joins one more rotation: chance meetings per probe are one in this number.
CHANCE = 12_000
#: Times ``tables``, for keys of one, two and three rotations: what keeps the recall.
MORE = (1, 5, 15)


def roots() -> np.ndarray:
    """The 240 minimal vectors of E8, (240, 8)."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1.0 if bits >> k & 1 else -1.0 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum) to the rows of ``x``."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    at = np.abs(off[odd]).argmax(axis=1)
    near[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to the rows of ``x``."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def rotation(dim: int, table: int, part: int) -> np.ndarray:
    """(dim, 8) projection whose coordinates of a random unit vector have about unit variance."""
    random = np.random.Generator(np.random.PCG64(np.random.SeedSequence([8, dim, table, part])))
    if dim >= 8:
        q, _ = np.linalg.qr(random.standard_normal((dim, 8)))
        return q * np.sqrt(dim)
    return random.standard_normal((dim, 8)) * np.sqrt(dim) / np.sqrt(8)


def _hash(points: np.ndarray, seed: np.ndarray) -> np.ndarray:
    key = seed
    doubled = np.rint(points * 2).astype(np.int64).view(U)
    for j in range(8):
        key = mix(key * U(0x9FB21C651E98DF25) + doubled[..., j])
    return key


def cells(unit: np.ndarray, seed: np.ndarray, table: int, parts: int, probes: int) -> np.ndarray:
    """(vectors, 1 + probes) keys: the own cell first, then the neighbouring ones, nearest first.

    With several parts a probe moves to a neighbouring cell in one part at a time.
    """
    own, off, point = [], [], []
    for part in range(parts):
        x = unit @ rotation(unit.shape[1], table, part) * SPREAD
        point.append(decode(x))
        off.append(x - point[-1])
        own.append(_hash(point[-1], seed + U(table * 64 + part + 1)))
    all_own = own[0] if parts == 1 else mix(np.add.reduce(own))
    if not probes:
        return all_own[:, None]
    minimal = roots()
    gain = np.concatenate([o @ minimal.T for o in off], axis=1)
    best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    out = np.empty((len(unit), 1 + probes), U)
    out[:, 0] = all_own
    for k in range(probes):
        part, root = best[:, k] // 240, best[:, k] % 240
        moved = np.choose(part[:, None], point) + minimal[root] if parts > 1 else point[0] + minimal[root]
        h = _hash(moved, seed + U(table * 64 + 1) + part.astype(U))
        out[:, 1 + k] = h if parts == 1 else mix(np.add.reduce(own) - np.choose(part, own) + h)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keys(parts: int, tables: int, probes: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own = batch.slice(at, 2048)
                widths = own.column("w").to_numpy(zero_copy_only=False)
                for width in np.unique(widths):
                    some = own.filter(pa.array(widths == width))
                    x = _matrix(some.column("v"))
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    seed = mix(some.column("label_key").to_numpy().view(U) + U(int(width)))
                    keys = np.concatenate([cells(unit, seed, t, parts, probes) for t in range(tables)], axis=1)
                    yield pa.record_batch([some.column("id"), lists(np.full(len(keys), keys.shape[1]), keys.view(np.int64).ravel())], ["id", "keys"])

    return run


def _verify(least: float):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = batch.column("w").to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                some = batch.filter(pa.array(width == w))
                x, y = _matrix(some.column("x")), _matrix(some.column("y"))
                x /= np.abs(x).max(axis=1, keepdims=True)
                y /= np.abs(y).max(axis=1, keepdims=True)
                cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                good = pa.array(cos >= least)
                yield pa.record_batch([some.column("a").filter(good), some.column("b").filter(good)], ["a", "b"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``table``.

    Rows of equal, not null labels are linked if the cosine of their vectors,
    in double precision, is at least ``least``.  ``n_links`` counts the other
    rows linked directly, copies included; ``component_id`` is the smallest id
    reachable.  Vectors that are null, empty, zero or hold a null or a value
    that is not finite, and rows with a null label, link with nothing and are
    kept.  Vectors of different lengths don't link.  Rows that repeat an id are
    rows of their own in the counts and share the id.  An empty table gives an
    empty result; other columns are not read.
    """
    scratch = Scratch(table.sparkSession, "lattice")
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable & F.col("label").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 are equal vectors but different bits; + 0.0 makes them one.
    bits = F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumns({"k1": F.when(F.col("usable"), F.xxhash64(bits)), "k2": F.when(F.col("usable"), F.xxhash64(F.lit(7), bits))})
    rows = scratch.write(rows, "rows")
    # Classes of equal vectors get numbers of their own, once, as the table is written; ids may repeat in different classes.
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    reps = rows.where("usable").join(classes.select("k1", "k2", F.col("rep").alias("id"), "cls"), ["k1", "k2", "id"]).dropDuplicates(["cls"])
    reps = scratch.write(reps.select("cls", F.xxhash64("label").alias("label_key"), F.size("v").alias("w"), "v"), "reps")
    largest = reps.groupBy("label_key").count().agg(F.max("count")).first()[0] or 0
    parts = 1
    while parts < len(MORE) and largest > 16 * CHANCE**parts:
        parts += 1
    tables *= MORE[parts - 1]
    keyed = reps.select(F.col("cls").alias("id"), "label_key", "w", "v").mapInArrow(_keys(parts, tables, probes), "id long, keys array<long>")
    keyed = scratch.write(keyed, "keys")
    home = keyed.select("id", F.explode(F.filter("keys", lambda _, i: i % (probes + 1) == 0)).alias("key"))
    look = keyed.select(F.col("id").alias("other"), F.explode("keys").alias("key"))
    met = home.join(look, "key").where("id <> other")
    met = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    vec = reps.select("cls", "w", "v", "label_key")
    one = vec.select(F.col("cls").alias("a"), "w", F.col("v").alias("x"), F.col("label_key").alias("l"))
    two = vec.select(F.col("cls").alias("b"), F.col("w").alias("w2"), F.col("v").alias("y"), F.col("label_key").alias("l2"))
    both = met.join(one, "a").join(two, "b").where("w = w2 and l = l2").select("a", "b", "w", "x", "y")
    links = scratch.write(both.mapInArrow(_verify(least), "a long, b long"), "links")
    sized = classes.select("k1", "k2", "cls", "rep", "copies")
    each = links.union(links.select("b", "a")).toDF("cls", "other")
    count = each.join(sized.select(F.col("cls").alias("other"), F.col("copies").alias("n")), "other").groupBy("cls").agg(F.sum("n").alias("n"))
    named = links.join(sized.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(sized.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
    comp = components(named.select("ra", "rb"), scratch, "ra", "rb")
    known = sized.join(count, "cls", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
