"""Edge cases of FIXTURES.md §4 on the generic operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from netlens.functions import predicates as P
import pytest

from netlens.operators import (count_hourly, count_where, crosstab, describe, distinct_hourly,
                               hourly_dense, mean_hourly, ratio_of_sums_hourly, share_hourly,
                               sum_hourly, value_counts)

T0 = dt.datetime(2025, 1, 9, 0, 10)


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_null_rcode_counts_as_failed(spark):
    df = _df(spark, [("a", T0, 0), ("a", T0, None), ("a", T0, 3)], "k string, ts timestamp, rcode int")
    r = share_hourly(df, "k", P.not_equal_or_null("rcode", 0), "x").first()
    assert abs(r["x"] - 2 / 3) < 1e-12
    assert count_where(df, P.not_equal("rcode", 0)).first()[0] == 1


def test_between_inclusive_null_out(spark):
    df = _df(spark, [(400,), (599,), (600,), (None,)], "s int")
    got = [r[0] for r in df.select(P.between("s", 400, 599)).collect()]
    assert got == [True, True, False, None]


def test_unusual_agent_null_is_unusual(spark):
    df = _df(spark, [("Mozilla/5",), (None,), ("curl",)], "ua string")
    got = [r[0] for r in df.select(P.not_matching("ua", "Mozilla|Chrome")).collect()]
    assert got == [False, True, True]


def test_ok_substring_any_case(spark):
    df = _df(spark, [("not OK",), ("self signed",), (None,)], "v string")
    got = [r[0] for r in df.select(P.set_and_lacks_ci("v", "ok")).collect()]
    assert got == [False, True, False]


def test_null_key_dropped(spark):
    df = _df(spark, [("a", T0), (None, T0)], "k string, ts timestamp")
    rows = count_hourly(df, "k").collect()
    assert [(r["k"], r["count"]) for r in rows] == [("a", 1)]


def test_all_null_groups(spark):
    df = _df(spark, [("a", T0, None), ("a", T0, None)], "k string, ts timestamp, v bigint")
    assert distinct_hourly(df, "k", "v", name="d").first()["d"] == 0
    assert sum_hourly(df, "k", "v", name="s").first()["s"] == 0
    assert mean_hourly(df, "k", "v", names=["m"]).first()["m"] is None
    assert mean_hourly(df, "k", "v", fill=0.0, names=["m"]).first()["m"] == 0.0


def test_ratio_of_sums_zero_rules(spark):
    df = _df(spark, [("a", T0, 0, 0), ("b", T0, 5, 0), ("c", T0, 1, None), ("d", T0, 1, 4)],
             "k string, ts timestamp, n bigint, d bigint")
    got = {r["k"]: r["r"] for r in ratio_of_sums_hourly(df, "k", "n", "d", "r").collect()}
    assert got["a"] == 0.0 and math.isinf(got["b"]) and got["b"] > 0
    assert math.isinf(got["c"]) and got["d"] == 0.25


def test_hourly_dense_fills_gaps(spark):
    df = _df(spark, [(dt.datetime(2025, 1, 9, 0, 5),), (dt.datetime(2025, 1, 9, 3, 59),)], "ts timestamp")
    got = [r["count"] for r in hourly_dense(df).orderBy("hour").collect()]
    assert got == [1, 0, 0, 1]
    assert hourly_dense(df.where(F.lit(False))).count() == 0


def test_key_hour_sparse(spark):
    df = _df(spark, [("a", dt.datetime(2025, 1, 9, 0)), ("b", dt.datetime(2025, 1, 9, 3))],
             "k string, ts timestamp")
    assert count_hourly(df, "k").count() == 2


def test_two_column_counts_keep_nulls(spark):
    df = _df(spark, [(1, None), (1, None), (None, 2)], "a int, b int")
    got = {(r["a"], r["b"]): r["count"] for r in value_counts(df, ["a", "b"], dropna=False).collect()}
    assert got == {(1, None): 2, (None, 2): 1}
    assert value_counts(df, ["a", "b"]).count() == 0


def test_crosstab_counts_other_values(spark):
    df = spark.createDataFrame([("a", "S0"), ("a", "new"), ("a", "odd"), ("b", "new"), ("c", None), (None, "S0")], "k string, s string")
    got = {r["k"]: (r["S0"], r["SF"], r["other"]) for r in crosstab(df, "k", "s", ["S0", "SF"]).collect()}
    assert got == {"a": (1, 0, 2), "b": (0, 0, 1)}
    assert crosstab(df, "k", "s", ["S0"], other=None).columns == ["k", "S0"]
    with pytest.raises(ValueError):
        crosstab(df, "k", "s", ["other"])


def test_crosstab_fills_zero(spark):
    df = _df(spark, [("a", "S0"), ("a", "SF"), ("b", "SF"), ("b", None)], "k string, s string")
    got = {r["k"]: (r["S0"], r["SF"]) for r in crosstab(df, "k", "s", ["S0", "SF"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 1)}


def test_describe_interpolates(spark):
    df = _df(spark, [(1,), (2,), (3,), (10,), (None,)], "x bigint")
    r = describe(df, "x").first()
    assert (r["count"], r["q25"], r["q50"], r["q75"]) == (4, 1.75, 2.5, 4.75)
    assert abs(r["std"] - 4.082483) < 1e-6 and r["min"] == 1.0 and r["max"] == 10.0


def test_describe_empty(spark):
    df = _df(spark, [(None,)], "x double")
    r = describe(df, "x").first()
    assert r["count"] == 0 and r["mean"] is None and r["q50"] is None


def test_hourly_dense_over_many_days(spark):
    df = _df(spark, [(dt.datetime(2025, 1, 9, 22, 5),), (dt.datetime(2025, 3, 10, 1, 5),)], "ts timestamp")
    rows = hourly_dense(df).orderBy("hour").collect()
    assert len(rows) == 59 * 24 + 4 and rows[0]["count"] == rows[-1]["count"] == 1
    assert sum(r["count"] for r in rows) == 2
    assert rows[0]["hour"] == dt.datetime(2025, 1, 9, 22) and rows[-1]["hour"] == dt.datetime(2025, 3, 10, 1)


def test_describe_approx_close(spark):
    rows = [(float(i % 1000),) for i in range(20000)]
    df = spark.createDataFrame(rows, "x double")
    e = describe(df, "x").first()
    a = describe(df, "x", exact=False).first()
    assert a["count"] == e["count"] and a["mean"] == e["mean"] and a["max"] == e["max"]
    for q in ("q25", "q50", "q75"):
        assert abs(a[q] - e[q]) <= 1000 * 2 / 10_000 * 10  # rank error bound, in value units


def test_approx_distinct_and_sorted_counts(spark):
    rows = [("a", T0, f"v{i % 7}") for i in range(50)] + [("b", T0, "v1")] * 3
    df = _df(spark, rows, "k string, ts timestamp, v string")
    exact = {r["k"]: r["d"] for r in distinct_hourly(df, "k", "v", name="d").collect()}
    approx = {r["k"]: r["d"] for r in distinct_hourly(df, "k", "v", name="d", approx=True).collect()}
    assert exact == approx == {"a": 7, "b": 1}
    got = [(r["v"], r["count"]) for r in value_counts(df, "v", sort=True).collect()]
    assert got[0] == ("v1", 10) and [c for _, c in got] == sorted((c for _, c in got), reverse=True)
