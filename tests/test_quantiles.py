"""Exact quantiles against numpy; building the plan runs no job."""

import numpy as np
import pytest

from netlens.operators import describe
from netlens.operators.quantiles import column_quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def _check(spark, values, **opts):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(8)
    got = column_quantiles(df, ["x"], PROBS, **opts).first()["quantiles"]
    assert np.allclose(got, np.quantile(np.array(values, dtype=float), PROBS), rtol=0, atol=1e-9)


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_uniform(spark, bins):
    _check(spark, np.random.default_rng(1).integers(0, 5000, 3000).tolist(), bins=bins)


@pytest.mark.parametrize("bins", [8, 1024])
def test_hot_value_third_of_rows(spark, bins):
    _check(spark, np.random.default_rng(2).lognormal(8, 2, 2000).round(3).tolist() + [42.0] * 1000, bins=bins)


def test_heavy_tail_and_few_values(spark):
    _check(spark, (np.random.default_rng(3).pareto(1.2, 3000) * 1000).round(2).tolist(), bins=4)
    _check(spark, [7.0], bins=4)
    _check(spark, [1.0, 2.0], bins=16)


def test_two_columns_nulls_and_nan(spark):
    rows = [(float(i % 7), None if i % 5 == 0 else float("nan") if i % 11 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["__ci"]: r["quantiles"] for r in column_quantiles(df, ["a", "b"], (0.25, 0.5), bins=8).collect()}
    b = [y for _, y in rows if y is not None and y == y]
    assert np.allclose(got[0], np.quantile([x for x, _ in rows], (0.25, 0.5)))
    assert np.allclose(got[1], np.quantile(b, (0.25, 0.5)))
    empty = spark.createDataFrame([(None,)], "a double")
    assert column_quantiles(empty, ["a"]).count() == 0


def test_building_a_summary_runs_no_job(spark):
    """The tracker counts the jobs of this thread's group."""
    spark.sparkContext.setJobGroup("build-summary", "")
    df = spark.range(1000).selectExpr("id % 97 AS x", "id AS y")
    d = describe(df, ["x", "y"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("build-summary")) == 0
    assert d.count() == 2
    spark.sparkContext.setJobGroup("tests", "")
