"""Exact quartiles on the driver's lineitem table (about 600,000 rows) and of the conn durations,
both at sf0.1, checked against DuckDB."""

import os

import duckdb
import pytest

from netlens.functions.rounding import report_round_sql
from netlens.operators import describe

SF = "/root/testdata/sf0.1"
COLS = ["l_extendedprice", "l_quantity", "l_discount"]
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no sf0.1 data")


def test_refinement_matches_duckdb(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = {r["column_name"]: r for r in
           describe(li, COLS).collect()}
    con = duckdb.connect()
    for c in COLS:
        x = f"CAST({c} AS DOUBLE)"
        q = [report_round_sql(f"quantile_cont({x}, {p})") for p in (0.25, 0.5, 0.75)]
        want = con.execute(f"SELECT count({x}), {report_round_sql(f'min({x})')}, {q[0]}, {q[1]}, {q[2]}, "
                           f"{report_round_sql(f'max({x})')} FROM read_parquet('{SF}/lineitem.parquet')").fetchone()
        r = got[c]
        assert (r["count"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == tuple(want), c


def test_conn_durations(spark):
    import __spark_entry__ as E
    from tools.compare_oracle import canon, duck
    df = E.queries()["conn_duration_summary"](spark, SF)
    res = duck(SF).execute(E.oracle_sql()["conn_duration_summary"])
    cols = [d[0] for d in res.description]
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, res.fetchall())
