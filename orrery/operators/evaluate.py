"""Scoring of model answers: admission, join, metrics at several levels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_evidence, normalize_label, parse_answer
from ..sources.shared import Scratch
from .hot import ranked

READY, CANDIDATE, UNKNOWN = "REFERENCE_READY", "CANDIDATE_REFERENCE", "UNKNOWN_REFERENCE"
SCORED = ("valid", "invalid", "failure")


def admission(declared: Column, review: Column, eligible: Column, has_reference: Column, explicit: bool = False) -> Column:
    """Struct (status, reason, contradiction): whether a reference may be scored, whatever a model answered."""
    withheld = F.coalesce(review.isin("pending", "pending_second_review", "rejected"), F.lit(False)) | F.coalesce(~eligible, F.lit(False))
    said = F.coalesce(declared == READY, F.lit(False))
    other = F.coalesce(declared.isin(CANDIDATE, UNKNOWN), F.lit(False))
    admitted = said | F.coalesce(review == "accepted", F.lit(False)) | F.coalesce(eligible, F.lit(False))
    short = F.lit(explicit) & ~admitted
    status = F.when(other, declared).when(withheld, F.when(has_reference, CANDIDATE).otherwise(UNKNOWN)).when(~has_reference, UNKNOWN).when(short, CANDIDATE).otherwise(READY)
    reason = F.when(other, "reference_not_admitted").when(withheld, "reference_review_pending_or_withheld").when(~has_reference, "reference_missing").when(short, "explicit_crater_reference_admission_required").otherwise("declared_reference")
    return F.struct(status.alias("status"), reason.alias("reason"), (said & (withheld | ~has_reference)).alias("contradiction"))


def per_request(requests: DataFrame, targets: DataFrame, predictions: DataFrame, response_format: str = "exact") -> DataFrame:
    """The fact table: a row for each request, with how it was scored.

    ``requests`` and ``targets`` match one to one on ``request_id``; a request
    without a prediction is a failure, not a lost row.
    """
    targets = targets.select("request_id", "answer", "review_status", *(c for c in ("reference_status", "scoring_eligible") if c in targets.columns))
    null = F.lit(None)
    declared = F.col("reference_status") if "reference_status" in targets.columns else null.cast("string")
    eligible = F.col("scoring_eligible") if "scoring_eligible" in targets.columns else null.cast("boolean")
    rows = requests.join(targets, "request_id").withColumn("_a", admission(declared, F.col("review_status"), eligible, F.col("answer").isNotNull()))
    rows = rows.join(predictions.select("request_id", "status", "raw_response", "elapsed_seconds"), "request_id", "left")
    labels, ok = F.col("allowed_answers"), F.coalesce(F.col("status") == "ok", F.lit(False)) & (F.size("allowed_answers") > 0)
    if response_format == "label_evidence":
        found = label_evidence(F.col("raw_response"), labels)
        rows = rows.withColumn("_p", F.when(ok, found))
        label, valid, evidence = F.col("_p.parsed_answer"), F.coalesce("_p.format_valid", F.lit(False)), F.col("_p.evidence")
    else:
        rows = rows.withColumn("_p", F.when(ok, parse_answer(F.col("raw_response"), labels)))
        label, valid, evidence = F.col("_p"), F.col("_p").isNotNull(), F.lit(None).cast("string")
    scoring = (
        F.when(F.size(labels) == 0, "unsupported_scoring")
        .when(F.col("_a.status") != READY, "unscored_reference")
        .when(F.coalesce(F.col("status"), F.lit("missing")) != "ok", "failure")
        .when(valid, "valid").otherwise("invalid")
    )
    answer = F.when(F.col("_a.status") == READY, F.when(F.size(labels) > 0, parse_answer(F.col("answer"), labels)).otherwise(F.col("answer")))
    rows = rows.select(
        "request_id", "task_id", "condition_id", "group_id", "allowed_answers", answer.alias("answer"),
        F.when(scoring != "invalid", label).alias("parsed_answer"), label.alias("recognized_label"), evidence.alias("evidence"),
        F.col("_a.status").alias("reference_status"), F.col("_a.reason").alias("reference_reason"), valid.alias("format_valid"),
        scoring.alias("scoring_status"), F.coalesce("status", F.lit("missing")).alias("response_status"), "elapsed_seconds",
    )
    correct = (F.col("scoring_status") == "valid") & F.coalesce(F.col("parsed_answer") == F.col("answer"), F.lit(False))
    return rows.withColumn("correct", F.when(F.col("scoring_status").isin(*SCORED), correct))


def measures() -> list[Column]:
    """Counts and rates of a group of per-request rows; invalid answers and failures stay in the denominator."""
    n, status = F.count("*"), F.col("scoring_status")
    count = lambda s: F.count_if(status == s)
    scored, correct = F.count_if(status.isin(*SCORED)), F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    rate = lambda a, b, name: F.round(F.try_divide(a, b), 6).alias(name)
    return [
        n.alias("n_total"), scored.alias("n_scored"), correct.alias("n_correct"),
        count("valid").alias("n_valid"), count("invalid").alias("n_invalid"), count("failure").alias("n_failure"),
        count("unscored_reference").alias("n_unscored"), rate(correct, scored, "accuracy"), rate(correct, count("valid"), "valid_only_accuracy"),
        rate(count("valid"), scored, "coverage"), rate(scored, n, "scoring_coverage"), rate(F.count_if(F.col("reference_status") == READY), n, "reference_coverage"),
    ]


def slices(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*measures())


def overall_and_slices(rows: DataFrame) -> DataFrame:
    """Both levels in one pass; the whole is 'ALL'."""
    out = rows.groupingSets([[], ["task_id", "condition_id"]], "task_id", "condition_id").agg(*measures())
    return out.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("task_id", "condition_id")})


def classification_gate(rows: DataFrame, *keys: str) -> DataFrame:
    """Why class metrics are given or not, for each group."""
    scored = F.col("scoring_status").isin(*SCORED)
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(scored).alias("s"), F.count_if(F.col("scoring_status") == "unscored_reference").alias("u"),
        F.count_distinct(F.when(scored, F.concat_ws("|", F.array_sort("allowed_answers")))).alias("sets"), F.count_distinct("task_id").alias("tasks"),
    )
    status = F.when(F.col("s") == 0, F.when(F.col("u") > 0, "unscored_reference").when(F.col("n") > 0, "unsupported_scoring").otherwise("empty")).when(F.col("sets") != 1, "incompatible_label_sets").when(F.col("tasks") > 1, "multiple_tasks_use_slices").otherwise("scored")
    return found.select(*keys, status.alias("classification_status"), F.col("s").alias("n_scored"))


def per_class(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 of each label; failures and invalid answers count as missed."""
    each = rows.where(F.col("scoring_status").isin(*SCORED)).select(*keys, "answer", "parsed_answer", F.explode("allowed_answers").alias("label"))
    truth, said = F.col("answer") == F.col("label"), F.coalesce(F.col("parsed_answer") == F.col("label"), F.lit(False))
    out = each.groupBy(*keys, "label").agg(F.count_if(truth).alias("support"), F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"))
    out = out.withColumn("fn", F.col("support") - F.col("tp"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp = F.col("tp")
    return out.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def macro_f1(classes: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 over the labels that have support."""
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return classes.where("support > 0").groupBy(*keys).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("n_classes"))


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Long confusion matrix: truth by predicted label, or 'invalid' or 'failure'."""
    kept = rows.where(F.col("scoring_status").isin(*SCORED))
    return kept.groupBy(*keys, F.col("answer").alias("truth"), F.coalesce("parsed_answer", "scoring_status").alias("predicted")).agg(F.count("*").alias("n"))


def binary(rows: DataFrame, *keys: str) -> DataFrame:
    """YES/NO block: rates over valid answers, and misses with failures included."""
    scored = rows.where(F.col("scoring_status").isin(*SCORED))
    yes = normalize_label(F.col("answer")) == "yes"
    valid, said = F.col("scoring_status") == "valid", F.coalesce(normalize_label(F.col("parsed_answer")) == "yes", F.lit(False))
    n = scored.groupBy(*keys).agg(
        F.count_if(valid & yes & said).alias("tp"), F.count_if(valid & ~yes & said).alias("fp"), F.count_if(valid & ~yes & ~said).alias("tn"),
        F.count_if(valid & yes & ~said).alias("fn"), F.count_if(yes).alias("n_positive"), F.count_if(yes & valid).alias("n_positive_valid"), F.count_if(~yes).alias("n_negative"),
    )
    c = F.col
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return n.withColumns({"fpr": ratio(c("fp"), c("fp") + c("tn")), "fnr": ratio(c("fn"), c("fn") + c("tp")), "positive_coverage": ratio(c("n_positive_valid"), c("n_positive")), "miss_rate_with_failures": ratio(c("n_positive") - c("tp"), c("n_positive"))})


def medians(rows: DataFrame, keys: list[str], value: str, into: str = "median") -> DataFrame:
    """(keys, median) of the values that aren't null, the mean of the middle two for an even number.

    Values are put in order over the whole table, in ranges, so a key with most of
    the rows is dealt to many tasks; only the rows at the middle places are joined.
    """
    scratch = Scratch(rows.sparkSession, "medians")
    placed, groups = ranked(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], scratch, "placed", "_at")
    spots = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    wanted = groups.select("first", F.explode(spots).alias("i")).select((F.col("first") + F.col("i")).alias("_at"))
    return placed.join(wanted, "_at").groupBy(*keys).agg(F.avg("_v").alias(into))


def runtime_stats(results: DataFrame, *keys: str) -> DataFrame:
    """Response counts and mean and median seconds of successful rows."""
    ok = F.col("status") == "ok"
    seconds = F.when(ok, F.col("elapsed_seconds"))
    out = results.groupBy(*keys).agg(
        F.count("*").alias("n_responses"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(F.col("status") == "unsupported").alias("n_unsupported"),
        F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"), F.round(F.avg(seconds), 6).alias("mean_seconds"),
    )
    own = {k: f"_k{i}" for i, k in enumerate(keys)}
    middle = medians(results.where(ok), list(keys), "elapsed_seconds", "_m").withColumnsRenamed(own)
    same = [out[k].eqNullSafe(middle[o]) for k, o in own.items()]
    return out.join(middle, reduce(and_, same), "left").withColumn("median_seconds", F.round("_m", 6)).drop("_m", *own.values())


def reference_counts(rows: DataFrame, *keys: str) -> DataFrame:
    ready = F.count_if(F.col("reference_status") == READY)
    scored = F.count_if(F.col("scoring_status").isin(*SCORED))
    status = F.when(scored == 0, "unavailable").when(ready < F.count("*"), "partial").otherwise("available")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_expected"), ready.alias("n_reference_ready"), (F.count("*") - ready).alias("n_unscored_reference"), status.alias("quality_status"))


def experiment_status(conditions: DataFrame, experiments: tuple[str, ...] = ()) -> DataFrame:
    """Roll-up of condition states: E1 the clean condition, E2 all others; of ``experiments`` those without a condition are not_selected."""
    groups = conditions.withColumn("experiment", F.when(F.col("condition_id") == "clean", "E1").otherwise("E2")).groupBy("experiment")
    state = F.when(F.bool_and(F.col("quality_status") == "available"), "available").when(F.bool_or(F.col("quality_status").isin("available", "partial")), "partial").otherwise("unavailable")
    out = groups.agg(state.alias("status"), F.count("*").alias("n_conditions"))
    if not experiments:
        return out
    wanted = conditions.sparkSession.createDataFrame([(e,) for e in experiments], "experiment string")  # a protocol's few names
    return F.broadcast(wanted).join(out, "experiment", "left").select("experiment", F.coalesce("status", F.lit("not_selected")).alias("status"), F.coalesce("n_conditions", F.lit(0)).alias("n_conditions"))


def format_tallies(responses: DataFrame, mode: str, pair: str) -> DataFrame:
    """By mode: completed, errors, valid labels, valid formats, budget hits, and pairs whose label differs between modes.

    Rows have status, label and format_valid, and hit_budget.  A pair counts as
    changed, in each mode, if all its responses are ok and have a label and the labels differ.
    """
    ok = F.col("status") == "ok"
    good = ok & F.col("label").isNotNull()
    changed = responses.groupBy(pair).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_all"), (F.min("label") != F.max("label")).alias("_differ")).where("_all and _differ").select(pair, F.lit(True).alias("_changed"))
    return responses.join(changed, pair, "left").groupBy(mode).agg(
        F.count("*").alias("completed"), F.count_if(~ok).alias("errors"), F.count_if(good).alias("valid_labels"), F.count_if(ok & F.col("format_valid")).alias("valid_formats"),
        F.count_if(ok & F.col("hit_budget")).alias("budget_hits"), F.count_distinct(F.when(F.col("_changed"), F.col(pair))).alias("changed_pairs"),
    )


def change_from_clean(rows: DataFrame, source_of: Column) -> DataFrame:
    """Accuracy of a condition less that of 'clean', null unless both scored the same sources."""
    scored = rows.where(F.col("scoring_status").isin(*SCORED)).withColumn("src", source_of)
    # A cohort is known by its size and an order-free fingerprint, so no set of sources meets in a row.
    finger = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src")).alias("x"), F.sum(F.xxhash64(F.lit(1), "src").cast("decimal(38,0)")).alias("s"))
    cohorts = scored.select("condition_id", "src").distinct().groupBy("condition_id").agg(finger.alias("cohort"))
    per = scored.groupBy("condition_id").agg(F.avg(F.col("correct").cast("double")).alias("accuracy")).join(cohorts, "condition_id")
    clean = per.where("condition_id = 'clean'").select(F.col("accuracy").alias("base"), F.col("cohort").alias("base_cohort"))
    # One row for each condition of a protocol, against one row.
    both = per.join(F.broadcast(clean), F.lit(True), "left")
    same = F.col("cohort") == F.col("base_cohort")
    return both.select("condition_id", F.round("accuracy", 6).alias("accuracy"), F.coalesce(same, F.lit(False)).alias("same_cohort"), F.round(F.when(same, F.col("accuracy") - F.col("base")), 6).alias("change_from_clean"))
