"""Mask metrics, thresholds, seeds and training statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORE = 255


def mask_counts(target: Column, predicted: Column) -> Column:
    """Struct tp, fp, fn, valid, ignored of two flat 0/1 masks; 255 in the target is neither right nor wrong."""
    pairs = F.zip_with(target, predicted, lambda t, p: F.when(t == IGNORE, F.lit(4)).otherwise(2 * t + p))
    n = lambda k: F.size(F.filter(pairs, lambda x: x == k)).cast("long")
    return F.struct(n(3).alias("tp"), n(1).alias("fp"), n(2).alias("fn"), (F.size(pairs) - n(4)).cast("long").alias("valid"), n(4).alias("ignored"))


def iou_or_one(tp: Column, fp: Column, fn: Column) -> Column:
    """Intersection over union of one image; two empty masks agree."""
    return F.when(tp + fp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fp + fn))


def dice_or_one(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(F.try_divide(2 * tp, 2 * tp + fp + fn))


def per_image(rows: DataFrame) -> DataFrame:
    """Counts and scores of rows with target and predicted masks."""
    c = rows.withColumn("c", mask_counts(F.col("target"), F.col("predicted"))).select("*", "c.*").drop("c", "target", "predicted")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"iou": iou_or_one(tp, fp, fn), "dice": dice_or_one(tp, fp, fn), "empty_target": tp + fn == 0})


def scene_macro(rows: DataFrame, scene: str = "scene", *keys: str) -> DataFrame:
    """Mean within a scene, then over scenes; beside it the mean over images."""
    inner = rows.groupBy(*keys, scene).agg(F.avg("iou").alias("i"), F.avg("dice").alias("d"), F.sum("iou").alias("s"), F.count("*").alias("n"))
    return inner.groupBy(*keys).agg(F.round(F.avg("i"), 6).alias("scene_iou"), F.round(F.avg("d"), 6).alias("scene_dice"), F.round(F.sum("s") / F.sum("n"), 6).alias("image_iou"), F.count("*").alias("n_scenes"))


def scene_breakdown(rows: DataFrame, scene: str = "scene") -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return rows.groupBy(scene).agg(F.count("*").alias("n_images"), F.round(F.avg("iou"), 6).alias("mean_iou"), ratio(tp, tp + fp + fn).alias("pooled_iou"), F.count_if("empty_target").alias("n_empty"))


def pooled(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp + fn).alias("iou"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def pixel_confusion(rows: DataFrame, classes: int = 2) -> DataFrame:
    """Per class: intersection, union, IoU, Dice; null where a class is in neither mask."""
    pixels = rows.select(F.explode(F.arrays_zip("target", "predicted")).alias("p")).select("p.*").where(F.col("target") != IGNORE)
    cell = pixels.groupBy("target", "predicted").agg(F.count("*").alias("n"))
    each = cell.select("*", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"))
    t, p, n = F.col("target") == F.col("class"), F.col("predicted") == F.col("class"), F.col("n")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    return each.groupBy("class").agg(
        total(t & p).alias("both"), total(t | p).alias("either"),
        F.round(F.try_divide(total(t & p), total(t | p)), 6).alias("iou"), F.round(F.try_divide(2 * total(t & p), total(t) + total(p)), 6).alias("dice"),
    )


def trivial(rows: DataFrame) -> DataFrame:
    """Each image twice, with a mask of nothing and a mask of everything as predictions."""
    kinds = F.explode(F.array(F.struct(F.lit("background").alias("kind"), F.lit(0).alias("fill")), F.struct(F.lit("foreground").alias("kind"), F.lit(1).alias("fill"))))
    return rows.withColumn("_k", kinds).withColumns({"kind": F.col("_k.kind"), "predicted": F.transform("target", lambda _: F.col("_k.fill"))}).drop("_k")


def pixel_summary(rows: DataFrame, classes: int = 2) -> DataFrame:
    """Mean IoU over the classes that occur, and the share of right pixels.

    Each image is counted in its row; no pixel is a row of its own.
    """
    pairs = F.filter(F.zip_with("target", "predicted", lambda t, p: F.when(t != IGNORE, t * classes + p)), lambda x: x.isNotNull())
    n = F.transform(F.sequence(F.lit(0), F.lit(classes * classes - 1)), lambda k: F.size(F.filter("x", lambda v: v == k)))
    sums = rows.select(pairs.alias("x")).select(n.alias("n")).agg(*(F.sum(F.get("n", k)).alias(f"n{k}") for k in range(classes * classes)))
    c = lambda t, p: F.col(f"n{t * classes + p}")
    total = lambda cells: sum((c(*x) for x in cells), F.lit(0))
    every = range(classes)
    iou = F.array_compact(F.array(*(F.try_divide(c(k, k), total([(k, j) for j in every] + [(j, k) for j in every if j != k])) for k in every)))
    whole = total([(t, p) for t in every for p in every])
    mean = F.try_divide(F.aggregate(iou, F.lit(0.0), lambda a, x: a + x), F.size(iou))
    return sums.select(F.round(mean, 6).alias("mean_iou"), F.round(F.try_divide(total([(k, k) for k in every]), whole), 6).alias("pixel_accuracy"), whole.alias("n_pixels"))


def threshold_select(rows: DataFrame, threshold: str = "threshold", score: str = "score") -> DataFrame:
    """The threshold of the best score, the smallest one of ties; a heap of one, not a sort."""
    return rows.orderBy(F.col(score).desc(), threshold).limit(1)


def mean_std(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and sample deviation over seeds; both null if any value is, the deviation also for one seed."""
    whole = F.count_if(F.col(value).isNull()) == 0
    return rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.round(F.when(whole, F.avg(value)), 6).alias("mean"), F.round(F.when(whole, F.stddev_samp(value)), 6).alias("std"))


def clean_minus_condition(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and deviation over seeds of clean less condition, seed by seed; positive is a degradation."""
    clean = rows.where("condition_id = 'clean'").select(*keys, "seed", F.col(value).alias("base"))
    both = rows.where("condition_id <> 'clean'").join(clean, [*keys, "seed"], "left").withColumn("drop", F.col("base") - F.col(value))
    return mean_std(both, "drop", *keys, "condition_id")


def train_normalisation(rows: DataFrame, values: str, cap: float = 20.0) -> DataFrame:
    """Mean and deviation of all entries, and background to foreground capped."""
    x = rows.select(F.explode(values).alias("x"))
    pos = F.count_if(F.col("x") > 0)
    return x.agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")), 6).alias("std"),
        F.round(F.least(F.lit(cap), F.try_divide(F.count("*") - pos, pos)), 6).alias("positive_weight"),
    )


def channel_statistics(rows: DataFrame, features: str, channels: int, group: str, foreground: str, background: str, cap: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """((channel, n, mean, std), one row positive_weight) of training images.

    ``features`` are channel after channel, an array; an image's sums are taken in
    place, so ``channels`` numbers travel and not its pixels.  Images of a group share one
    weight between them: background to foreground of the groups' means, ``cap`` at most,
    and null if either is nowhere.  Images whose features don't divide into channels go.
    """
    good = rows.where((F.size(features) > 0) & (F.size(features) % channels == 0))
    n = (F.size(features) / channels).cast("int")
    part = lambda c: F.slice(features, c * n + 1, n)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    each = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.struct(n.cast("long").alias("n"), total(part(c)).alias("s"), total(F.transform(part(c), lambda x: x * x)).alias("q")))
    sums = good.select(F.posexplode(each).alias("channel", "x")).groupBy("channel").agg(F.sum("x.n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
    mean = F.col("s") / F.col("n")
    per = sums.select("channel", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))
    share = rows.groupBy(group).agg((F.sum(foreground) / F.count("*")).alias("f"), (F.sum(background) / F.count("*")).alias("b"))
    ratio = F.when((F.sum("f") > 0) & (F.sum("b") > 0), F.least(F.lit(cap), F.sum("b") / F.sum("f")))
    return per, share.agg(ratio.alias("positive_weight"))


def group_weights(rows: DataFrame, group: str) -> DataFrame:
    """N / (G n_g) for each group: a grouped count, then two totals over the groups."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))
    return per.select(group, "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def softmax(values: Column) -> Column:
    """Stable softmax of an array."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def argmax(values: Column) -> Column:
    """Index of the first greatest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
