"""Plan checks on every registered query: no Python in the plan, pruned scans,
few exchanges, time filters pushed to the scan."""

import re

import pytest

from netlens.plans import catalog
from netlens.plans.features import dense_keys
from netlens.plans.registry import analytics

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    queries = catalog.queries()
    for a in analytics():
        out[a.key] = _plan(queries[a.key](spark, SF))
    return out


def _derived(k: str) -> bool:
    """Summaries and dense series work on their own small aggregates after the first one."""
    return k.endswith("_summary") or k in dense_keys("conn")


def test_no_python_and_pruned_scans(plans):
    for k, p in plans.items():
        assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", p), k
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
            assert "props" not in schema, (k, schema)


def test_exchange_counts(plans):
    for k, p in plans.items():
        n = p.count("Exchange ")
        if _derived(k):  # before execution: reused exchanges are still shown once for each use
            assert not re.search(r"Window \[[^\]]*\], \[\]", p), k  # no window over everything
            continue
        assert n <= 2, (k, n)
        if k.endswith("_hourly") and "unique" not in k and not k.startswith("conn_"):
            assert n == 1, (k, n)


def test_hourly_scans_push_time_filter(plans):
    for k, p in plans.items():
        if k.endswith("_hourly"):
            assert "IsNotNull(ts)" in p, k


def test_detail_queries_do_not_shuffle(plans):
    for k in ["conn_heavy_senders", "conn_host_detail", "conn_port9_detail", "conn_endpoints",
              "conn_tcp_downloads", "conn_high_bytes_per_pkt"]:
        assert "Exchange" not in plans[k], k


def test_aggregates_combine_map_side(plans):
    """Hot keys: every shuffle feeding an aggregate ships partial aggregates (a key with a
    third of the rows sends one partial row per task), never raw rows."""
    for k, p in plans.items():
        if "Exchange hashpartitioning" in p and "HashAggregate" in p and not _derived(k):
            assert "partial_" in p or "merge_" in p, k
            # the first operator above the scan side of each exchange is a partial aggregate
            for block in p.split("Exchange hashpartitioning")[1:]:
                below = block.split("\n", 2)[1] if "\n" in block else ""
                assert "Aggregate" in below, (k, below[:120])
