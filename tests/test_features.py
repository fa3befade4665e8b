"""The one-aggregate feature table gives exactly the per-analytic results."""

import pytest

import __spark_entry__ as E
from netlens.plans.features import feature_keys, host_hour_features, split_features
from netlens.sources.views import log_view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("log_type", ["dns", "files", "http", "kerberos", "ssl", "weird"])
def test_split_equals_individual(spark, log_type):
    v = log_view(spark, SF, log_type)
    split = split_features(host_hour_features(v, log_type), log_type)
    qs = E.queries()
    assert set(split) == set(feature_keys(log_type))
    for k, df in split.items():
        want = qs[k](spark, SF)
        assert df.columns == want.columns, k
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())), k


@pytest.mark.parametrize("log_type", ["conn", "dns", "files", "http", "kerberos", "ssl", "weird"])
def test_frequency_split_equals_individual(spark, log_type):
    from netlens.plans.features import frequency_keys, frequency_tables, split_frequencies
    v = log_view(spark, SF, log_type)
    split = split_frequencies(frequency_tables(v, log_type), v.schema, log_type)
    qs = E.queries()
    assert set(split) == set(frequency_keys(log_type))
    for k, df in split.items():
        want = qs[k](spark, SF)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want.schema], k
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), k


def test_dense_split_equals_individual(spark):
    from netlens.plans.features import dense_keys, hourly_counts_table, split_dense
    v = log_view(spark, SF, "conn")
    split = split_dense(hourly_counts_table(v, "conn"), "conn")
    assert set(split) == set(dense_keys("conn")) and len(split) == 5
    for k, df in split.items():
        want = E.queries()[k](spark, SF)
        assert df.columns == want.columns, k
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())), k
