"""Operators against a pandas brute force on random data (NULLs, ties, a hot key)."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st

from netlens.functions import predicates as P
from netlens.operators import (count_hourly, distinct_hourly, hourly_dense, mean_hourly,
                               share_hourly, sum_hourly, top_k, value_counts)

T0 = dt.datetime(2025, 1, 9)

row = st.tuples(
    st.one_of(st.none(), st.sampled_from(["hot", "hot", "hot", "a", "b", "c"])),  # key, hot-skewed
    st.integers(0, 6 * 3600 - 1),                                                   # seconds
    st.one_of(st.none(), st.integers(0, 5)),                                        # rcode-like
    st.one_of(st.none(), st.sampled_from(["x", "y", "z"])),                          # value
    st.one_of(st.none(), st.floats(0, 100, allow_nan=False)),                        # metric
)


def _frames(spark, rows):
    data = [(k, T0 + dt.timedelta(seconds=s), r, v, m) for k, s, r, v, m in rows]
    sdf = spark.createDataFrame(data, "k string, ts timestamp, r int, v string, m double")
    pdf = pd.DataFrame(data, columns=["k", "ts", "r", "v", "m"]).set_index("ts")
    return sdf, pdf


def _as_dict(df, metric):
    return {(r["k"], r["hour"]): r[metric] for r in df.collect()}


def _pd_dict(series):
    return {(k, h.to_pydatetime()): v for (k, h), v in series.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=60))
def test_hourly_operators_match_pandas(spark, rows):
    sdf, pdf = _frames(spark, rows)
    g = pdf.groupby(["k", pd.Grouper(freq="1h")])
    assert _as_dict(count_hourly(sdf, "k"), "count") == _pd_dict(g.size())
    assert _as_dict(distinct_hourly(sdf, "k", "v", name="d"), "d") == _pd_dict(g["v"].nunique())
    s_sum = _as_dict(sum_hourly(sdf, "k", "m", name="s"), "s")
    for key, val in _pd_dict(g["m"].sum()).items():
        assert abs(s_sum[key] - val) < 1e-9
    s_mean = _as_dict(mean_hourly(sdf, "k", "m", names=["mm"]), "mm")
    for key, val in _pd_dict(g["m"].mean()).items():
        assert (s_mean[key] is None and np.isnan(val)) or abs(s_mean[key] - val) < 1e-9
    failed = pdf[pdf["r"].astype(float) != 0].groupby(["k", pd.Grouper(freq="1h")]).size()
    want = (failed / g.size()).fillna(0)
    got = _as_dict(share_hourly(sdf, "k", P.not_equal_or_null("r", 0), "f"), "f")
    assert got.keys() == _pd_dict(want).keys()
    for key, val in _pd_dict(want).items():
        assert abs(got[key] - val) < 1e-12


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=60))
def test_frequency_and_dense_match_pandas(spark, rows):
    sdf, pdf = _frames(spark, rows)
    vc = pdf["v"].value_counts()
    assert {r["v"]: r["count"] for r in value_counts(sdf, "v").collect()} == vc.to_dict()
    top = [(r["v"], r["count"]) for r in top_k(sdf, "v", 2).collect()]
    want = sorted(vc.items(), key=lambda t: (-t[1], t[0]))[:2]
    assert top == want
    dense = {r["hour"]: r["count"] for r in hourly_dense(sdf).collect()}
    want = {h.to_pydatetime(): n for h, n in pdf.resample("1h").size().items()}
    assert dense == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=80),
       st.integers(2, 40))
def test_describe_matches_pandas(spark, values, cap):
    from netlens.operators import describe
    vals = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = describe(df, "x", digits=None, bins=cap).first()
    d = pd.Series(vals, dtype="float64").describe()
    assert r["count"] == int(d["count"])
    if r["count"] == 0:
        assert r["q50"] is None
        return
    for ours, theirs in [("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                         ("q75", "75%"), ("max", "max")]:
        assert abs(r[ours] - d[theirs]) <= 1e-9 * max(1.0, abs(d[theirs])), (ours, r[ours], d[theirs])
    if r["count"] > 1:
        assert abs(r["std"] - d["std"]) <= 1e-6 * max(1.0, abs(d["std"]))
