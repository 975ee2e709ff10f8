"""Duplicates, near-duplicates and overlap between splits and cohorts.

Similarity joins are equi-joins on blocks (three parts of a 64-bit hash), and
alternatives are unions of equi-joins, so no plan compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chunks, hamming


def duplicate_groups(rows: DataFrame, key: str, id_col: str = "id", split: str = "split") -> DataFrame:
    """Keys of several rows, with their number, first id and distinct splits (counts and extremes, no unbounded list)."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.array_sort(F.collect_set(split)).alias("splits"))
    return out.where("n > 1").select(key, "n", "first_id", F.concat_ws(",", "splits").alias("splits"), (F.size("splits") > 1).alias("cross_split"))


def split_statistics(rows: DataFrame, split: str = "split") -> DataFrame:
    """Images, foreground and background pixels, share, empty and constant images, groups, by split."""
    fg, bg = F.sum("foreground"), F.sum("background")
    return rows.groupBy(split).agg(
        F.count("*").alias("n_images"), fg.alias("foreground"), bg.alias("background"), F.round(F.try_divide(fg, fg + bg), 6).alias("foreground_fraction"),
        F.count_if(F.col("foreground") == 0).alias("n_empty"), F.count_if("constant").alias("n_constant"), F.count_distinct("group_id").alias("n_groups"),
    )


def near_pairs(rows: DataFrame, id_col: str = "id", bits: str = "bits", distance: int = 2, equal: bool = False) -> DataFrame:
    """(a, b, distance) of rows whose hashes differ in 1 to ``distance`` (at most 2) bits, and with ``equal`` in none.

    Rows of one hash are one row first, so copies don't multiply in a block; the
    pairs of different hashes are then given back their ids.
    """
    blocks = rows.select(bits).distinct().select(bits, F.explode(chunks(F.col(bits))).alias("c"))
    left = blocks.select(F.col("c.k").alias("k"), F.col("c.bits").alias("part"), F.col(bits).alias("x"))
    right = left.withColumnRenamed("x", "y")
    met = left.join(right, ["k", "part"]).where(F.col("x") < F.col("y")).where(hamming(F.col("x"), F.col("y")) <= distance).select("x", "y").distinct()
    if equal:
        met = met.unionByName(rows.groupBy(F.col(bits).alias("x")).count().where("count > 1").select("x", F.col("x").alias("y")))
    ids = rows.select(F.col(id_col).alias("i"), F.col(bits))
    out = met.join(ids.select(F.col("i").alias("p"), F.col(bits).alias("x")), "x").join(ids.select(F.col("i").alias("q"), F.col(bits).alias("y")), "y").where("x <> y or p < q")
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), hamming(F.col("x"), F.col("y")).alias("distance"))


def near_classes(rows: DataFrame, id_col: str = "id", bits: str = "bits", distance: int = 2) -> DataFrame:
    """(a, b, n_a, n_b, distance) of different hashes at most ``distance`` (2 or less) bits apart, each by its smallest id and its number of rows.

    Rows of one hash stay one class, so copies multiply neither the join nor the
    result: n_a times n_b tells how many pairs of rows a pair of classes stands for.
    Rows without a hash are like nothing.
    """
    classes = rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("h")).agg(F.min(id_col).alias("i"), F.count("*").alias("n"))
    left = classes.select("h", "i", "n", F.explode(chunks(F.col("h"))).alias("c")).select("h", "i", "n", "c.k", F.col("c.bits").alias("part"))
    right = left.withColumnsRenamed({"h": "g", "i": "j", "n": "m"})
    met = left.join(right, ["k", "part"]).where(F.col("i") < F.col("j")).where(hamming(F.col("h"), F.col("g")) <= distance)
    return met.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("n").alias("n_a"), F.col("m").alias("n_b"), hamming(F.col("h"), F.col("g")).alias("distance")).distinct()


def _near(current: DataFrame, prior: DataFrame, distance: int) -> DataFrame:
    """(x, y) hashes of both tables within the distance; rows of one hash are one row first."""
    part = lambda rows, name: rows.select(F.col("bits").alias(name)).distinct().select(name, F.explode(chunks(F.col(name))).alias("c")).select(name, "c.k", F.col("c.bits").alias("part"))
    return part(current, "x").join(part(prior, "y"), ["k", "part"]).where(hamming(F.col("x"), F.col("y")) <= distance).select("x", "y").distinct()


def near_across(current: DataFrame, prior: DataFrame, distance: int = 2) -> DataFrame:
    """(id, prior_id) pairs of two tables whose hashes lie within the distance, equal ones too."""
    return _near(current, prior, distance).join(current.select("id", F.col("bits").alias("x")), "x").join(prior.select(F.col("id").alias("prior_id"), F.col("bits").alias("y")), "y").select("id", "prior_id")


def near_count(current: DataFrame, prior: DataFrame, distance: int = 2) -> DataFrame:
    """One row ``n_near``: how many pairs of the two tables' rows ``near_across`` would give, from the sizes of their hashes' classes."""
    size = lambda rows, h, n: rows.groupBy(F.col("bits").alias(h)).agg(F.count("*").alias(n))
    met = _near(current, prior, distance).join(size(current, "x", "n"), "x").join(size(prior, "y", "m"), "y")
    return met.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_near"))


def overlap_counts(current: DataFrame, prior: DataFrame, distance: int = 2) -> DataFrame:
    """(id, n_stem, n_content, n_near) of each current row: prior rows of its stem, of its content, and of near hashes with other content.

    Rows of a key are counted before they are joined, so neither a hot stem nor
    copies of one image multiply; null keys agree with nothing.
    """
    count = lambda name, *by: prior.groupBy(*by).agg(F.count("*").alias(name))
    out = current.select("id", "stem", "content", "bits").join(count("n_stem", "stem"), "stem", "left").join(count("n_content", "content"), "content", "left")
    close = _near(current, prior, distance).join(count("n", F.col("bits").alias("y")), "y").groupBy(F.col("x").alias("bits")).agg(F.sum("n").alias("every"))
    # Of those, the ones of the same content: content classes meet by an equi-join.
    far = prior.groupBy("content", F.col("bits").alias("y")).agg(F.count("*").alias("n"))
    same = current.select("content", "bits").distinct().join(far, "content").where(hamming(F.col("bits"), F.col("y")) <= distance).groupBy("content", "bits").agg(F.sum("n").alias("own"))
    out = out.join(close, "bits", "left").join(same, ["content", "bits"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("id", zero("n_stem").alias("n_stem"), zero("n_content").alias("n_content"), (zero("every") - zero("own")).alias("n_near"))


def prior_overlap(current: DataFrame, prior: DataFrame, distance: int = 2) -> DataFrame:
    """(id, prior_id, reasons) by stem, by equal content, or else by a near hash; a union of three equi-joins.

    Both tables have id, stem, content and bits.  A pair's reasons are three
    flags, so pairs are grouped in rows of fixed size, which spill, and no lists are held.
    """
    names = ["decoded_pixels_overlap", "near_duplicate_review", "source_id_overlap"]
    flags = lambda name: [F.lit(n == name).alias(n) for n in names]
    far = prior.select(F.col("id").alias("prior_id"), "stem", "content")
    stem = current.select("id", "stem").join(far.select("prior_id", "stem"), "stem").select("id", "prior_id", *flags("source_id_overlap"))
    same = current.select("id", "content").join(far.select("prior_id", "content"), "content").select("id", "prior_id", *flags("decoded_pixels_overlap"))
    near = near_across(current, prior, distance).select("id", "prior_id", *flags("near_duplicate_review"))
    every = stem.unionByName(same).unionByName(near).groupBy("id", "prior_id").agg(*(F.max(n).alias(n) for n in names))
    why = every.withColumn(names[1], F.col(names[1]) & ~F.col(names[0]))
    return why.select("id", "prior_id", F.concat_ws(",", *(F.when(F.col(n), n) for n in names)).alias("reasons"))


def exclusion_reason(rows: DataFrame, excluded: DataFrame, distance: int = 2) -> DataFrame:
    """(id, reason): the first of stem, group, file, content and near hash that ``excluded`` also has; null for none."""
    out = rows
    for name, key in (("source_id_overlap", "stem"), ("scene_group_overlap", "group_id"), ("file_hash_overlap", "file"), ("decoded_pixels_overlap", "content")):
        out = out.join(excluded.select(key).distinct().withColumn(f"_{name}", F.lit(name)), key, "left")
    near = _near(rows, excluded, distance).select(F.col("x").alias("bits")).distinct().withColumn("_near", F.lit("near_duplicate_dhash"))
    out = out.join(near, "bits", "left")
    return out.select("id", F.coalesce("_source_id_overlap", "_scene_group_overlap", "_file_hash_overlap", "_decoded_pixels_overlap", "_near").alias("reason"))


def overlap_any(rows: DataFrame, training: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that agree with ``training`` on any of the keys: one semi-join for each, united."""
    out = None
    for key in keys:
        own = rows.join(training.select(key).distinct(), key, "left_semi").select("id")
        out = own if out is None else out.union(own)
    return out.distinct()


def flag_groups(rows: DataFrame, training: DataFrame, keys: list[str], name: str = "in_training") -> DataFrame:
    return rows.join(training.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def keys_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def keys_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def cohorts_equal(rows: DataFrame, run: str, key: str) -> DataFrame:
    """Runs with the size and an order-free fingerprint of their key sets, and whether all runs agree."""
    per = rows.select(run, key).distinct().groupBy(run).agg(F.count("*").alias("n_keys"), F.bit_xor(F.xxhash64(key)).alias("x"), F.sum(F.xxhash64(F.lit(1), F.col(key)).cast("decimal(38,0)")).alias("s"))
    distinct = per.select("n_keys", "x", "s").distinct().count()
    return per.select(run, "n_keys").withColumn("same_cohort", F.lit(distinct <= 1))


def split_intersections(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Number of keys that each pair of splits shares; the pairs of a key are bounded by the number of splits."""
    each = rows.select(key, split).distinct()
    pairs = each.join(each.withColumnRenamed(split, "other"), key).where(F.col(split) < F.col("other"))
    return pairs.groupBy(split, "other").agg(F.count("*").alias("n_shared"))


def exact_partition(parts: DataFrame, whole: DataFrame, key: str) -> Column | DataFrame:
    """(n_twice, n_missing, n_extra): whether parts are disjoint and cover the whole."""
    seen = parts.groupBy(key).agg(F.count("*").alias("n"))
    both = seen.join(whole.select(key).distinct().withColumn("w", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("n_twice"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_extra"))


def verdict(groups: DataFrame, near: DataFrame, statistics: DataFrame, crossing: DataFrame) -> DataFrame:
    """(n_cross_duplicates, n_near, n_constant, n_cross_groups, verdict) of an audit; any of them asks for a review.

    ``groups`` are duplicate groups, ``near`` one row with the number of near pairs across
    splits (``near_count``), ``statistics`` the splits', ``crossing`` groups in several splits.
    """
    counts = [groups.agg(F.count_if("cross_split").alias("n_cross_duplicates")), near.select("n_near"), statistics.agg(F.coalesce(F.sum("n_constant"), F.lit(0)).alias("n_constant")), crossing.agg(F.count("*").alias("n_cross_groups"))]
    out = counts[0]
    for more in counts[1:]:
        out = out.crossJoin(F.broadcast(more))  # one row each
    clean = (F.col("n_cross_duplicates") == 0) & (F.col("n_near") == 0) & (F.col("n_constant") == 0) & (F.col("n_cross_groups") == 0)
    return out.withColumn("verdict", F.when(clean, "pass").otherwise("review_required"))
