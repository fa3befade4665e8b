"""The per-day job: raw files -> landed Parquet -> every analytic of the type."""

import os

import pytest

from netlens import jobs
from netlens.plans.registry import analytics

WEIRD = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "name", "addl", "notice",
         "peer", "source"]


def test_ingest_then_report(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    p = os.path.join(raw, "2025-01-09", "weird", "weird.00_00_00-01_00_00.log")
    os.makedirs(os.path.dirname(p))
    rows = [("1736380800.5", "10.0.0.1", "bad_TCP", "T"), ("1736380900.0", "10.0.0.1", "dns_unmatched", "F"),
            ("1736384500.0", "10.0.0.2", "bad_TCP", "-")]
    with open(p, "w") as f:
        f.write("#separator \\x09\n#path\tweird\n#fields\t" + "\t".join(WEIRD) + "\n")
        for ts, h, n, notice in rows:
            vals = {"ts": ts, "id.orig_h": h, "id.resp_h": "10.0.0.9", "name": n, "notice": notice,
                    "source": "TCP"}
            f.write("\t".join(vals.get(c, "-") for c in WEIRD) + "\n")
    landed = os.path.join(tmpdir_path, "landed")
    jobs.ingest(spark, raw, landed, ["2025-01-09"], ["weird", "dns"])
    out = os.path.join(tmpdir_path, "out")
    written = jobs.report(spark, landed, "weird", "2025-01-09", out)
    assert len(written) == len(analytics("weird")) + 2  # + the two shared tables
    assert any(w.endswith("_host_hour_features") for w in written)
    assert any(w.endswith("_frequencies") for w in written)
    names = spark.read.parquet(os.path.join(out, "weird", "2025-01-09", "weird_name_counts"))
    assert sorted((r["name"], r["count"]) for r in names.collect()) == [("bad_TCP", 2), ("dns_unmatched", 1)]
    unshared = jobs.report(spark, landed, "weird", "2025-01-09", os.path.join(tmpdir_path, "o2"),
                           export=False, shared=False)
    for w in unshared:
        key = os.path.basename(w)
        a = spark.read.parquet(w).collect()
        b = spark.read.parquet(os.path.join(out, "weird", "2025-01-09", key)).collect()
        assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str), key
    ratio = spark.read.parquet(os.path.join(out, "weird", "2025-01-09", "weird_notice_ratio_hourly"))
    got = sorted((r["id_orig_h"], r["notice_ratio"]) for r in ratio.collect())
    assert got == [("10.0.0.1", 0.5), ("10.0.0.2", 0.0)]
    assert os.path.exists(os.path.join(out, "weird", "2025-01-09", "_export"))


def test_conn_report_on_sparse_log(spark, tmpdir_path):
    """A conn file with only a few columns runs every conn analytic on request; otherwise the
    absent columns are named."""
    raw = os.path.join(tmpdir_path, "raw")
    p = os.path.join(raw, "2025-01-09", "conn", "conn.1.log")
    os.makedirs(os.path.dirname(p))
    with open(p, "w") as f:
        f.write("#fields\tts\tid.orig_h\tid.resp_h\tconn_state\tduration\n")
        f.write("1736380800.5\t10.0.0.1\t10.0.0.9\tS0\t0.2\n1736388000.5\t10.0.0.1\t10.0.0.8\tSF\t3.0\n")
    from netlens.sources.zeek import read_log
    with pytest.raises(ValueError, match="id_orig_p.*history"):
        jobs.report_tables(read_log(spark, raw, "conn"), "conn")
    with pytest.raises(ValueError, match="orig_bytes"):
        jobs.ingest(spark, raw, os.path.join(tmpdir_path, "landed"), ["2025-01-09"], ["conn"])
    with pytest.warns(UserWarning, match="orig_bytes"):
        tables = jobs.report_tables(read_log(spark, raw, "conn"), "conn", allow_missing=True)
    assert tables["conn_hourly"].count() == 3
    assert tables["conn_short_count"].first()[0] == 1
    for k, df in tables.items():
        df.collect()


def test_conn_subset_day_variant(spark):
    from netlens.plans import conn
    from netlens.sources.views import log_view
    v = log_view(spark, "/root/testdata/sf0.001", "conn")
    t = jobs.report_tables(v, "conn", conn.SUBSET_KEYS, conn.SUBSET_PARAMS)
    assert set(t) == set(conn.SUBSET_KEYS)
    assert "resp_bytes" not in t["conn_heavy_senders"].columns
    assert "conn_state" not in t["conn_broadcast_detail"].columns
    assert t["conn_short_non_dns_dests"].count() == 5


def test_report_rejects_unknown_keys(spark, tmpdir_path):
    with pytest.raises(ValueError):
        jobs.report(spark, os.path.join(tmpdir_path, "none"), "dns", "2025-01-09",
                    os.path.join(tmpdir_path, "o"), keys=["dns_no_such_key"])


def test_cli_in_process(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    p = os.path.join(raw, "2025-01-09", "weird", "weird.1.log")
    os.makedirs(os.path.dirname(p))
    with open(p, "w") as f:
        f.write("#fields\t" + "\t".join(WEIRD) + "\n")
        f.write("\t".join({"ts": "1736380800.5", "id.orig_h": "10.0.0.1", "name": "n", "notice": "T"}
                          .get(c, "-") for c in WEIRD) + "\n")
    landed, out = os.path.join(tmpdir_path, "landed"), os.path.join(tmpdir_path, "out")
    jobs.main(["ingest", "--raw", raw, "--landed", landed, "--date", "2025-01-09", "--type", "weird"])
    jobs.main(["report", "--landed", landed, "--type", "weird", "--date", "2025-01-09", "--out", out,
               "--key", "weird_notice_ratio_hourly", "--key", "weird_events_hourly"])
    got = spark.read.parquet(os.path.join(out, "weird", "2025-01-09", "weird_notice_ratio_hourly")).collect()
    assert [(r["id_orig_h"], r["notice_ratio"]) for r in got] == [("10.0.0.1", 1.0)]


def test_cli_list(capsys):
    jobs.main(["list", "--type", "ssl"])
    out = capsys.readouterr().out.strip().splitlines()
    assert len(out) == len(analytics("ssl")) and all(line.count("\t") == 2 for line in out)
    assert all(line.split("\t")[2] for line in out)  # every analytic has a description


def test_conn_report_shared_equals_unshared(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    p = os.path.join(raw, "2025-01-09", "conn", "conn.1.log")
    os.makedirs(os.path.dirname(p))
    with open(p, "w") as f:
        f.write("#fields\tts\tid.orig_h\tid.resp_h\tid.resp_p\tproto\tconn_state\tduration\torig_bytes\n")
        f.write("1736380800.5\t10.0.0.1\t255.255.255.255\t53\tudp\tS0\t0.2\t10\n")
        f.write("1736391600.5\t10.0.0.1\t10.0.0.8\t443\ttcp\tSF\t3.0\t2000000\n")
        f.write("1736398800.5\t10.0.0.2\t10.0.0.8\t53\tudp\tRSTO\t0.1\t5\n")
    landed = os.path.join(tmpdir_path, "landed")
    jobs.ingest(spark, raw, landed, ["2025-01-09"], ["conn"], allow_missing=True)
    a = jobs.report(spark, landed, "conn", "2025-01-09", os.path.join(tmpdir_path, "a"), export=False)
    b = jobs.report(spark, landed, "conn", "2025-01-09", os.path.join(tmpdir_path, "b"), export=False,
                    shared=False)
    assert any(w.endswith("_hourly_counts") for w in a)
    for w in b:
        key = os.path.basename(w)
        x = spark.read.parquet(w).collect()
        y = spark.read.parquet(os.path.join(tmpdir_path, "a", "conn", "2025-01-09", key)).collect()
        assert sorted(map(tuple, x), key=str) == sorted(map(tuple, y), key=str), key
    hourly = spark.read.parquet(os.path.join(tmpdir_path, "a", "conn", "2025-01-09", "conn_dns_hourly"))
    assert [r["count"] for r in hourly.orderBy("hour").collect()] == [1, 0, 0, 0, 0, 1]


def _one_day(root, types=None):
    """A small file of every type; each with all the columns its analytics read."""
    from netlens import schemas as Z
    value = {"ts": "1736380800.5", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.9", "rcode": "0", "qtype": "1", "query": "a.example",
             "conn_state": "SF", "duration": "0.5", "orig_bytes": "10", "orig_pkts": "1", "name": "bad", "notice": "T", "success": "F"}
    for t in types or Z.REQUIRED:
        p = os.path.join(root, "2025-01-09", t, f"{t}.1.log")
        os.makedirs(os.path.dirname(p))
        with open(p, "w") as f:
            f.write("#fields\t" + "\t".join(Z.REQUIRED[t]) + "\n" + "\t".join(value.get(c, "-") for c in Z.REQUIRED[t]) + "\n")


def test_all_types_of_a_day_landed_together(spark, tmpdir_path):
    """Every report of the shared landed root equals the report of the type landed alone."""
    from netlens import schemas as Z
    from netlens.sources.ingest import read_landed
    raw, landed = os.path.join(tmpdir_path, "raw"), os.path.join(tmpdir_path, "landed")
    _one_day(raw)
    jobs.ingest(spark, raw, landed, ["2025-01-09"])
    for t in Z.REQUIRED:
        alone = os.path.join(tmpdir_path, "alone-" + t)
        jobs.ingest(spark, raw, alone, ["2025-01-09"], [t])
        a, b = (jobs.report_tables(read_landed(spark, x, t, ["2025-01-09"]), t) for x in (landed, alone))
        for k in a:
            assert sorted(map(tuple, a[k].collect()), key=str) == sorted(map(tuple, b[k].collect()), key=str), k
    dns = jobs.report_tables(read_landed(spark, landed, "dns"), "dns")
    assert [r["failed_ratio"] for r in dns["dns_failed_ratio_hourly"].collect()] == [0.0]
    assert [tuple(r) for r in dns["dns_rcode_counts"].collect()] == [(0, 1)]


def test_missing_day_is_a_warning(spark, tmpdir_path):
    raw, landed = os.path.join(tmpdir_path, "raw"), os.path.join(tmpdir_path, "landed")
    _one_day(raw, ["weird"])
    with pytest.warns(UserWarning, match="2025-01-10"):
        jobs.ingest(spark, raw, landed, ["2025-01-09", "2025-01-10"], ["weird"])
    from netlens.sources.ingest import read_landed
    assert read_landed(spark, landed, "weird").count() == 1
