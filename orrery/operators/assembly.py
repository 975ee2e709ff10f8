"""Building and sealing data sets: projections, strict joins, gates, picks and checks.

Checks give violations as rows (rule, key, detail), as ``validate`` does; an
empty result means that a data set is sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .validate import broken, duplicates, unmatched

VIOLATION = ("rule", "key", "detail")


def split_io(rows: DataFrame, key: str, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs, targets): two projections that share the key and no other column."""
    return rows.drop(*targets), rows.select(key, *targets)


def strict_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """What keeps two tables from joining one to one: keys that repeat on a side or lack the other."""
    sides = a.groupBy(key).agg(F.count("*").alias("na")).join(b.groupBy(key).agg(F.count("*").alias("nb")), key, "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    found = F.array(
        F.when(n("na") == 0, "left_missing"), F.when(n("nb") == 0, "right_missing"), F.when(n("na") > 1, "left_repeated"), F.when(n("nb") > 1, "right_repeated"),
    )
    return sides.select(F.explode(F.array_compact(found)).alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws("/", n("na"), n("nb")).alias("detail"))


def strict_join(a: DataFrame, b: DataFrame, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Inner join without the descriptive columns of ``b``; use after ``strict_violations`` was empty."""
    return a.join(b.drop(*drop), key)


def rebase(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths of an array of structs moved from one folder to another; others stay."""
    moved = lambda p: F.when(p.startswith(old + "/"), F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1)))).otherwise(p)
    return rows.withColumn(column, F.transform(column, lambda x: x.withField("path", moved(x["path"]))))


def by_locator(manifest: DataFrame, rows: DataFrame, content: str = "content") -> DataFrame:
    """Manifest entries with the container row they name, and whether its content has the hash that was recorded."""
    found = rows.select("container", "row_index", F.sha2(content, 256).alias("actual"))
    out = manifest.join(found, ["container", "row_index"], "left")
    state = F.when(F.col("actual").isNull(), "row_missing").when(F.col("actual") != F.col("sha256"), "hash_differs").otherwise("verified")
    return out.select("id", "container", "row_index", state.alias("state"))


def coverage_with_depth(samples: DataFrame, depth: DataFrame, key: str) -> DataFrame:
    """Samples with the shape of their depth map, or the first reason that leaves them out."""
    both = samples.join(depth.select(key, F.col("height").alias("d_height"), F.col("width").alias("d_width"), "valid_share"), key, "left")
    reason = (
        F.when(F.col("d_height").isNull(), "depth_missing")
        .when((F.col("d_height") != F.col("height")) | (F.col("d_width") != F.col("width")), "shape_differs")
        .when(F.col("valid_share") < 0.5, "coverage_low")
    )
    return both.select(key, reason.alias("reason"))


def readout(detections: DataFrame, image: str, least: float = 0.5) -> DataFrame:
    """Detections that a reader counts: sure enough and drawn whole."""
    return detections.where((F.col("score") >= least) & F.col("eligible"))


def replayed(answers: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions that differ from the answer computed anew, or stand on one side alone."""
    both = answers.withColumnRenamed("answer", "computed").join(predictions.withColumnRenamed("answer", "stored"), keys, "full")
    return both.where(~F.col("computed").eqNullSafe(F.col("stored"))).select(*keys, "computed", "stored")


def group_sizes(rows: DataFrame, key: str, expected: int, per: str, distinct: int) -> DataFrame:
    """Keys that haven't ``expected`` rows in ``distinct`` different values of ``per``."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(per).alias("k"))
    return n.where((F.col("n") != expected) | (F.col("k") != distinct)).select(F.lit("group_size").alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws("/", "n", "k").alias("detail"))


def rejections(rows: DataFrame, area: str, reason: str = "reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(F.concat_ws(":", area, reason).alias("reason")).agg(F.count("*").alias("n"))


def class_support(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """Pixels and images of each value; counts of an image are made before anything is shuffled."""
    own = rows.select(key, F.explode(F.array_distinct(mask)).alias("value"), F.col(mask).alias("m")).select(key, "value", F.size(F.filter("m", lambda x: x == F.col("value"))).alias("n"))
    return own.groupBy("value").agg(F.sum("n").alias("pixels"), F.count("*").alias("images"))


def registration_errors(rows: DataFrame, key: str, hypothesis: str, error: str) -> DataFrame:
    """Mean, median and 90 % of the absolute error of each hypothesis, by key, and the key's best one."""
    e = F.abs(error)
    # A key's errors under one hypothesis are its tie points: bounded by the image.
    per = rows.groupBy(key, hypothesis).agg(F.avg(e).alias("mae"), F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(e, F.lit(0.9)).alias("p90"), F.count("*").alias("n"))
    return per.groupBy(key).agg(F.min_by(F.struct(hypothesis, "mae", "median", "p90", "n"), F.struct("mae", hypothesis)).alias("best")).select(key, "best.*")


# --- picks --------------------------------------------------------------------------------------


def stratified(rows: DataFrame, scene: str, pool: Column, quotas: dict[str, int], order: Column) -> DataFrame:
    """Of each scene the first rows of each pool, as many as its quota, by ``order``.

    Ranks beyond a quota are never kept, so the window works with a limit for each group.
    """
    wanted = F.create_map(*[F.lit(x) for k, n in sorted(quotas.items()) for x in (k, n)])
    ranked = rows.withColumn("pool", pool).withColumn("place", F.row_number().over(W.partitionBy(scene, "pool").orderBy(order)))
    return ranked.where(F.col("place") <= max(quotas.values())).where(F.col("place") <= F.coalesce(F.try_element_at(wanted, F.col("pool")), F.lit(0)))


def best_of_groups(rows: DataFrame, group: str, order: list[str], id_col: str, limit: int) -> DataFrame:
    """The best row of each group, and of these the best ``limit``: an aggregate and a heap, no sort of all rows."""
    best = rows.groupBy(group).agg(F.min(F.struct(*order, id_col)).alias("b")).select(group, "b.*")
    return best.orderBy(*order, id_col).limit(limit)


def hash_pick(key: Column, n: Column) -> Column:
    """A place below ``n`` from the first eight bytes of the key's digest, as an unsigned number."""
    digest = F.sha2(key, 256)
    half = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long")
    # (high * 2 ** 32 + low) % n without leaving 64 bits: n is below 2 ** 31.
    return ((half(1) % n) * (F.lit(1 << 32) % n) + half(9) % n) % n


def fewest_first(rows: DataFrame, group: str, order: Column, total: int) -> DataFrame:
    """``total`` rows, one more from the group of which fewest were taken each time (ties by group)."""
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("turn") <= total).orderBy("turn", group).limit(total)


# --- gates --------------------------------------------------------------------------------------


def collection_gates(tracks: DataFrame, per_track: int, total: int) -> DataFrame:
    """Rules of an assembled collection: rows of a track, unique ids and hashes, groups that don't cross from train to test."""
    sizes = tracks.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") != per_track)
    sizes = sizes.select(F.lit("track_size").alias("rule"), F.col("track").cast("string").alias("key"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail"))
    whole = tracks.agg(F.count("*").alias("n")).where(F.col("n") != total).select(F.lit("total").alias("rule"), F.lit("all").alias("key"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail"))
    crossing = tracks.groupBy("group_id").agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") != "train").cast("int")).alias("b")).where("a = 1 and b = 1")
    crossing = crossing.select(F.lit("group_crosses").alias("rule"), F.col("group_id").cast("string").alias("key"), F.lit("").alias("detail"))
    return sizes.unionByName(whole).unionByName(duplicates(tracks, "id", "id_twice")).unionByName(duplicates(tracks, "sha256", "hash_twice")).unionByName(crossing)


def exclusions(manifests: dict[str, DataFrame], training: DataFrame, keys: tuple[str, ...] = ("id", "group_id", "file", "content", "bits")) -> DataFrame:
    """(kind, value, sources): every id, group, file and hash of earlier manifests and the training cohort, once each."""
    out = None
    for name, rows in {**manifests, "training": training}.items():
        each = rows.select(F.lit(name).alias("source"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys if k in rows.columns))).alias("x"))
        out = each if out is None else out.unionByName(each)
    found = out.select("x.*", "source").where("value is not null").groupBy("kind", "value").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return found.select("kind", "value", F.concat_ws(",", "s").alias("sources"))


def cache_complete(features: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Violations of a feature cache: ids on one side alone, rows whose split or group differs, more than one channel count."""
    both = manifest.select(key, F.col("split").alias("ms"), F.col("group_id").alias("mg"), F.lit(True).alias("m")).join(features.select(key, "split", "group_id", "channels", F.lit(True).alias("f")), key, "full")
    rules = F.array(F.when(F.col("f").isNull(), "feature_missing"), F.when(F.col("m").isNull(), "feature_unknown"), F.when(F.col("m") & F.col("f") & (~F.col("ms").eqNullSafe(F.col("split")) | ~F.col("mg").eqNullSafe(F.col("group_id"))), "split_or_group_differs"))
    rows = both.select(F.explode(F.array_compact(rules)).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))
    channels = features.agg(F.min("channels").alias("a"), F.max("channels").alias("b")).where("a <> b")
    return rows.unionByName(channels.select(F.lit("channels_differ").alias("rule"), F.lit("all").alias("key"), F.concat_ws("-", "a", "b").alias("detail")))


def confirmations(reviews: DataFrame, objects: DataFrame) -> DataFrame:
    """Reviews bound to one object by sample and instance: state of each, 'bound' only if hash, box and flags agree."""
    per = objects.groupBy("sample", "instance").agg(F.count("*").alias("n"), F.min(F.struct("build_sha", "box", "human")).alias("o"))
    both = reviews.join(per, ["sample", "instance"], "left")
    state = (
        F.when(F.col("n").isNull(), "object_missing").when(F.col("n") > 1, "object_ambiguous")
        .when(F.col("build_sha") != F.col("o.build_sha"), "other_build")
        .when((F.col("box") != F.col("o.box")) | (F.col("human") != F.col("o.human")), "object_changed").otherwise("bound")
    )
    return both.select("sample", "instance", state.alias("state"))


def pair_quality(rows: DataFrame, key: str, image: str, mask: str) -> DataFrame:
    """Size and value rules of an image and its binary mask, with the foreground's count and share."""
    fg = F.size(F.filter(mask, lambda x: x == 1))
    return rows.select(
        key, (F.size(image) == F.size(mask)).alias("same_size"), F.forall(mask, lambda x: x.isin(0, 1)).alias("binary"),
        fg.cast("long").alias("foreground"), F.round(F.try_divide(fg, F.size(mask)), 6).alias("fraction"),
    )


def sequence_state(ids: Column, steps: Column, end_id: int, budget: Column) -> Column:
    """Struct of a generated sequence: length of its prompt, whether it ended by itself, whether it used its budget up."""
    new = F.slice(ids, F.size(ids) - steps + 1, steps)
    ended = F.coalesce(F.array_contains(new, end_id), F.lit(False))
    return F.struct((F.size(ids) - steps).alias("prefix"), ended.alias("ended"), (~ended & (steps >= budget)).alias("hit_budget"))


def bijection(a: DataFrame, a_key: Column, b: DataFrame, b_key: Column) -> DataFrame:
    """Keys derived from two layouts of names that aren't in exactly one row of each."""
    return strict_violations(a.select(a_key.alias("k")), b.select(b_key.alias("k")), "k")


def recomputed(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Cached figures that a new computation doesn't give: (keys, column, stored, fresh)."""
    long = lambda rows, name: rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(name)) for c in values))).alias("x")).select(*keys, "x.*")
    both = long(stored, "stored").join(long(fresh, "fresh"), [*keys, "column"], "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("fresh")))


def hash_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, size, sha256) of a bundle's entries."""
    return files.select("path", F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """State of each entry that a sealed manifest or a folder has: verified, missing, extra or changed."""
    now = hash_manifest(files, content).select("path", F.col("size").alias("size_now"), F.col("sha256").alias("sha_now"))
    both = manifest.join(now, "path", "full")
    state = F.when(F.col("sha_now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("size") != F.col("size_now")) | (F.col("sha256") != F.col("sha_now")), "changed").otherwise("verified")
    return both.select("path", state.alias("state"))


def sealed(rows: DataFrame, key: str, rules: dict[str, Column], count: int, allowed: DataFrame, group: str) -> DataFrame:
    """Violations of a sealed build: row rules, repeated keys, groups that the build doesn't list, and its row count."""
    found = broken(rows, key, rules).unionByName(duplicates(rows, key, "key_twice")).unionByName(unmatched(rows, allowed, group, "group_unlisted"))
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") != count)
    return found.unionByName(n.select(F.lit("row_count").alias("rule"), F.lit("all").alias("key"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail")))


def claims(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Latest state of each job of an event log, and its owner: the first worker whose claim found the job free.

    A claim after another is lost, as in a compare-and-set; 'release' frees a job.
    """
    turn = W.partitionBy(job).orderBy(*order)
    free = F.coalesce(F.lag("event").over(turn), F.lit("release")) == "release"
    won = events.withColumn("won", (F.col("event") == "claim") & free)
    last = won.groupBy(job).agg(F.max_by("event", F.struct(*order)).alias("state"), F.max_by(F.when(F.col("won"), F.col("worker")), F.when(F.col("won"), F.struct(*order))).alias("owner"), F.count_if((F.col("event") == "claim") & ~F.col("won")).alias("n_lost"))
    return last.select(job, "state", F.when(F.col("state") != "release", F.col("owner")).alias("owner"), "n_lost")
