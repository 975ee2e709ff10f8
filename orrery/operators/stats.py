"""Bootstrap intervals over groups.

Totals of a group are aggregated in the JVM first; only they, one row for each
independent group, reach the Python function that resamples.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVAL = "difference double, n_pairs long, n_groups long, lower double, upper double, warning string"


def _percentile(values: list[float], p: float) -> float:
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def paired_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Group totals of right minus left correctness over the requests that both runs have scored."""
    both = left.select("request_id", "group_id", F.col("correct").cast("int").alias("l")).join(right.select("request_id", F.col("correct").cast("int").alias("r")), "request_id")
    return both.where("l is not null and r is not null").groupBy("group_id").agg(F.sum(F.col("r") - F.col("l")).alias("total"), F.count("*").alias("n"))


def paired_bootstrap(totals: DataFrame, seed: int = 0, repetitions: int = 1000) -> DataFrame:
    """Ratio estimator of the paired difference with a percentile interval over resampled groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        total, n = pdf["total"].tolist(), pdf["n"].tolist()
        point, low, high, warning = sum(total) / sum(n), None, None, None
        if len(n) < 2:
            warning = "insufficient_independent_groups"
        else:
            rng, found, order = random.Random(seed), [], list(range(len(n)))
            for _ in range(repetitions):
                drawn = [rng.choice(order) for _ in order]
                found.append(sum(total[k] for k in drawn) / sum(n[k] for k in drawn))
            found.sort()
            low, high = _percentile(found, 0.025), _percentile(found, 0.975)
        return pd.DataFrame([[point, sum(n), len(n), low, high, warning]], columns=["difference", "n_pairs", "n_groups", "lower", "upper", "warning"])

    return totals.groupBy().applyInPandas(run, INTERVAL)


def scene_differences(rows: DataFrame, left: str, right: str, scene: str = "scene") -> DataFrame:
    """(scene, value): mean over a scene's images of left less right."""
    return rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(scene).agg(F.avg(F.col(left) - F.col(right)).alias("value"))


def scene_interval(differences: DataFrame, seed: int = 2026, repetitions: int = 2000) -> DataFrame:
    """Mean of scenes' mean differences with a percentile interval; a paired comparison of two methods or encoders."""
    return scene_bootstrap(differences, "value", seed, repetitions)


def scene_bootstrap(scenes: DataFrame, value: str = "value", seed: int = 2026, repetitions: int = 2000) -> DataFrame:
    """Mean over scenes (one row each) with a percentile interval."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("scene")[value].to_numpy(float)
        mean, low, high = float(values.mean()), None, None
        if len(values) > 1:
            drawn = values[np.random.default_rng(seed).integers(0, len(values), (repetitions, len(values)))].mean(axis=1)
            low, high = (float(q) for q in np.quantile(drawn, [0.025, 0.975]))
        return pd.DataFrame([[mean, len(values), low, high]], columns=["mean", "n_scenes", "lower", "upper"])

    return scenes.select(F.col("scene").cast("string").alias("scene"), F.col(value)).groupBy().applyInPandas(run, "mean double, n_scenes long, lower double, upper double")
