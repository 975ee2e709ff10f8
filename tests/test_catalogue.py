"""Every registered query against its SQL, or for a stable schema where it has none."""

import pytest
from helpers import DATA, same

from orrery.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in catalogue.ORACLE:
        same(df, duck.sql(catalogue.ORACLE[name]))
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 12 and df.columns[:2] == ["task_id", "condition_id"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["near_duplicates", "prior_overlap", "exclusion_reason", "box_overlaps"])
def test_similarity_joins_have_no_nested_loop(spark, name):
    plan = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["modality_match"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


@pytest.mark.parametrize("n", [1, 7])
def test_rows_order_and_partitions_dont_matter(spark, n):
    from orrery.operators import evaluate
    from orrery.plans import relations as R

    d = f"{DATA}/sf0.001"
    a, b, c = R.requests(spark, d), R.targets(spark, d), R.predictions(spark, d)
    want = sorted(map(str, evaluate.slices(evaluate.per_request(a, b, c), "task_id").collect()))
    got = evaluate.slices(evaluate.per_request(a.repartition(n), b.orderBy("request_id"), c.repartition(n)), "task_id")
    assert sorted(map(str, got.collect())) == want
