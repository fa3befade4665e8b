"""The report rounding is bit-identical in Spark, Python and DuckDB, ties included."""

import duckdb
import numpy as np

from netlens.functions.rounding import report_round, report_round_py, report_round_sql


def test_same_bits_everywhere(spark):
    rng = np.random.default_rng(7)
    # means of few-decimal values: exact ties at the 7th decimal are common
    vals = [float(x) for x in (rng.integers(-10**7, 10**7, 400) / 2 / 10**6)]
    vals += [0.0158525, 2.5e-7, -2.5e-7, 0.0, 1e9, -3e12, 123456.0000005, 1e9 + 0.12345678, 2.0 ** 53 / 1e6 - 0.3]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got_spark = [r[0] for r in df.select(report_round(df["x"])).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    got_duck = [r[0] for r in con.execute(f"SELECT {report_round_sql('x')} FROM t ORDER BY i").fetchall()]
    got_py = [report_round_py(v) for v in vals]
    assert got_spark == got_py == got_duck
    assert report_round_py(0.0158525) in (0.015852, 0.015853)
    assert report_round_py(-3e12) == -3e12 and report_round_py(None) is None
