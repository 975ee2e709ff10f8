"""Known answers of the evaluator."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.text import label_evidence, labels_distinct, parse_answer
from orrery.operators import evaluate, runs, select, stats, validate
from orrery.sources import manifests


def triple(spark, truths, outputs, labels=("YES", "NO"), task="t", groups=None):
    n = range(len(truths))
    groups = groups or ["g"] * len(truths)
    req = spark.createDataFrame([(f"r{i}", task, "clean", groups[i], list(labels)) for i in n], "request_id string, task_id string, condition_id string, group_id string, allowed_answers array<string>")
    tar = spark.createDataFrame([(f"r{i}", truths[i], None) for i in n], "request_id string, answer string, review_status string")
    rows = [(f"r{i}", "error" if o == "!" else "ok", "" if o == "!" else o, 1.0) for i, o in enumerate(outputs) if o is not None]
    pred = spark.createDataFrame(rows, "request_id string, status string, raw_response string, elapsed_seconds double")
    return evaluate.per_request(req, tar, pred)


def test_binary_with_failures(spark):
    rows = triple(spark, ["YES"] * 4 + ["NO"] * 4, ["YES", "NO", "some prose", None, "YES", "NO", "?", "!"])
    s = evaluate.slices(rows).first()
    assert (s.n_scored, s.n_correct, s.n_invalid, s.n_failure, s.accuracy, s.valid_only_accuracy, s.coverage) == (8, 2, 2, 2, 0.25, 0.5, 0.5)
    b = evaluate.binary(rows).first()
    assert (b.tp, b.fp, b.tn, b.fn, b.fpr, b.fnr, b.miss_rate_with_failures) == (1, 1, 1, 1, 0.5, 0.5, 0.75)
    classes = {r.label: r for r in evaluate.per_class(rows).collect()}
    assert classes["YES"].fn == 3
    assert evaluate.macro_f1(evaluate.per_class(rows)).first().macro_f1 == pytest.approx(1 / 3, abs=1e-6)


def test_multiclass_counts_supported_labels_only(spark):
    rows = triple(spark, ["A", "A", "B"], ["A", "C", "B"], ("A", "B", "C"))
    classes = {r.label: r for r in evaluate.per_class(rows).collect()}
    assert classes["C"].recall is None and classes["C"].f1 == 0
    assert evaluate.macro_f1(evaluate.per_class(rows)).first().macro_f1 == pytest.approx((2 / 3 + 1) / 2, abs=1e-6)


def test_all_missing_and_free_form(spark):
    assert evaluate.slices(triple(spark, ["YES"], [None])).first().accuracy == 0
    free = triple(spark, ["YES"], ["YES"], ()).first()
    assert free.scoring_status == "unsupported_scoring" and free.correct is None


@pytest.mark.parametrize(("text", "want"), [(" \tYeS\n", "YES"), ("YES.", None), ('"YES"', None), ("it is YES", None), ("", None), ("big    ROCK", "Big Rock"), ("no ", "NO")])
def test_parser(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string").select(parse_answer(F.col("x"), F.array(*map(F.lit, ("YES", "NO", "Big Rock")))).alias("y"))
    assert df.first().y == want


def test_evidence_needs_both_lines(spark):
    labels = F.array(F.lit("YES"), F.lit("NO"))
    get = lambda t: spark.createDataFrame([(t,)], "x string").select(label_evidence(F.col("x"), labels).alias("r")).first().r
    assert get("ANSWER: yes\nEVIDENCE: a rim").format_valid
    only = get("ANSWER: YES")
    assert only.label_valid and not only.format_valid and only.evidence is None
    assert get("ANSWER: unsure\nEVIDENCE: x").abstained


def test_labels_distinct(spark):
    df = spark.createDataFrame([(["A", "a "],), (["A", "B"],), ([" "],)], "x array<string>").select(labels_distinct(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [False, True, False]


def test_bootstrap(spark):
    left = triple(spark, ["YES"] * 3, ["NO"] * 3, groups=["0", "0", "1"])
    right = triple(spark, ["YES"] * 3, ["YES", "NO", "YES"], groups=["0", "0", "1"])
    r = stats.paired_bootstrap(stats.paired_totals(left, right), seed=7, repetitions=200).first()
    assert r.difference == pytest.approx(2 / 3) and r.n_groups == 2 and 0 <= r.lower <= r.upper <= 1
    one = triple(spark, ["YES"], ["YES"])
    r = stats.paired_bootstrap(stats.paired_totals(one, one)).first()
    assert r.lower is None and r.warning == "insufficient_independent_groups"


def test_violations_are_found(spark):
    bad = spark.createDataFrame([("a", "ok", float("nan"), "x"), ("b", "lost", 1.0, "x"), ("c", "ok", 1.0, None), ("c", "ok", 1.0, "y")], "request_id string, status string, elapsed_seconds double, raw_response string")
    rules = {(r.rule, r.key) for r in validate.broken(bad, "request_id", validate.prediction_rules()).collect()}
    assert rules == {("seconds_not_finite", "a"), ("status_unknown", "b"), ("response_null", "c")}
    assert validate.duplicates(bad, "request_id", "twice").first().key == "c"
    with pytest.raises(ValueError, match="twice: c"):
        validate.require_empty(validate.duplicates(bad, "request_id", "twice"))
    with pytest.raises(ValueError, match="mask"):
        validate.assert_no_leak(spark.createDataFrame([(1,)], "mask int"))


def test_adapter_errors_become_rows(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", None)], "request_id string, prompt string")
    got = {r.request_id: r for r in runs.run_adapter(rows, lambda: runs.Mock({"a": "YES"})).collect()}
    assert got["a"].raw_response == "YES" and got["b"].status == "error" and got["b"].error_message == "ValueError: no prompt"
    reg = runs.Registry(("mock",))
    reg.add("x", runs.Mock)
    for name in ("x", "mock", ""):
        with pytest.raises(ValueError):
            reg.add(name, runs.Mock)
    assert runs.response_rules(rows, runs.run_adapter(rows, runs.Mock)).count() == 0


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(20)], "request_id long, t string")
    assert manifests.fingerprint(a).first() == manifests.fingerprint(a.orderBy(F.desc("request_id")).repartition(3)).first()
    assert manifests.fingerprint(a).first() != manifests.fingerprint(a.where("request_id > 0")).first()


def test_quotas_add_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 5), ("d", 1)], "k string, n long")
    got = {r.k: r.quota for r in select.proportional_quotas(sizes, "k", "n", 20, 12).collect()}
    assert sum(got.values()) == 20 and got["a"] == 12 and all(got[k] <= n for k, n in (("b", 10), ("c", 5), ("d", 1)))


def test_early_stopping_waits(spark):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.5, 3.0])], "run string, step int, v double")
    assert [r.wait for r in select.early_stopping(rows, "run", "step", "v").orderBy("step").collect()] == [0, 0, 1, 2, 0]


def test_empty_tables(spark):
    rows = triple(spark, ["YES"], ["YES"]).where("false")
    assert evaluate.slices(rows, "task_id").count() == 0 and evaluate.per_class(rows).count() == 0


def test_quotas_against_rounds(spark):
    """More capped scenes than any number of rounds: the closed form against capping one scene after another."""
    r = random.Random(3)
    for total, cap in ((200, 12), (90, 5), (1000, 40), (30, 100)):
        sizes = {f"s{i:02d}": r.randrange(1, 90) for i in range(25)}
        quota, free, left = {}, dict(sizes), total
        while True:
            full = [k for k, n in free.items() if left * n / sum(free.values()) >= min(n, cap)]
            if not full:
                break
            for k in full:
                quota[k] = min(free[k], cap)
            free = {k: n for k, n in sizes.items() if k not in quota}
            left = total - sum(quota.values())
            if not free:
                break
        exact = {k: left * n / sum(free.values()) for k, n in free.items()}
        rest = left - sum(map(int, exact.values()))
        for place, k in enumerate(sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))):
            quota[k] = int(exact[k]) + (place < rest)
        df = spark.createDataFrame(list(sizes.items()), "k string, n long")
        assert {x.k: x.quota for x in select.proportional_quotas(df, "k", "n", total, cap).collect()} == quota
