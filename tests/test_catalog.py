"""Every registered analytic against its DuckDB oracle (the driver's gate), at sf0.001,
plus the entry smoke check and property checks on the driver tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from netlens.plans import catalog
from tools.compare_oracle import canon, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data missing")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert len(catalog.queries()) >= 110
    assert set(catalog.queries()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id_orig_h", "hour", "failed_ratio"]
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert canon(df.columns, s_rows) == canon(d_cols, res.fetchall())


def test_ratios_in_unit_interval(spark):
    for key in ["dns_failed_ratio_hourly", "http_proxied_ratio_hourly", "ssl_invalid_cert_ratio_hourly",
                "kerberos_failed_ratio_hourly", "weird_notice_ratio_hourly"]:
        df = E.queries()[key](spark, SF)
        c = df.columns[-1]
        assert df.where((F.col(c) < 0) | (F.col(c) > 1) | F.col(c).isNull()).count() == 0


def test_hourly_counts_sum_to_rows(spark):
    q = E.queries()
    total = q["conn_columns_shape"](spark, SF).first()["n_rows"]
    assert q["conn_hourly"](spark, SF).agg(F.sum("count")).first()[0] == total
    dense = q["conn_dns_hourly"](spark, SF).agg(F.sum("count")).first()[0]
    non = q["conn_non_dns_hourly"](spark, SF).agg(F.sum("count")).first()[0]
    nulls = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 41 = 0").count()
    assert dense + non + nulls == total


def test_share_equals_two_aggregate_join(spark):
    """A16 as one conditional aggregate equals the source's aligned division."""
    from netlens.sources.views import log_view
    from netlens.operators import count_hourly
    from netlens.functions import predicates as P
    v = log_view(spark, SF, "dns")
    one = E.queries()["dns_failed_ratio_hourly"](spark, SF)
    num = count_hourly(v, "id_orig_h", P.not_equal_or_null("rcode", 0), name="f")
    den = count_hourly(v, "id_orig_h", name="t")
    two = (den.join(num, ["id_orig_h", "hour"], "full")
              .select("id_orig_h", "hour", F.coalesce(F.col("f") / F.col("t"), F.lit(0.0)).alias("failed_ratio")))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("key,log_type,col", [
    ("dns_rcode_counts", "dns", "rcode"), ("conn_state_counts", "conn", "conn_state"),
    ("http_status_counts", "http", "status_code"), ("ssl_validation_counts", "ssl", "validation_status"),
    ("weird_notice_counts", "weird", "notice"), ("kerberos_success_counts", "kerberos", "success"),
])
def test_frequency_plus_nulls_is_rows(spark, key, log_type, col):
    from netlens.sources.views import log_view
    v = log_view(spark, SF, log_type)
    total = v.count()
    nulls = v.where(F.col(col).isNull()).count()
    counted = E.queries()[key](spark, SF).agg(F.sum("count")).first()[0]
    assert counted + nulls == total
