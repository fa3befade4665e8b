"""Streaming hourly features equal the batch operators on the same files."""

import os

from netlens.functions import predicates as P
from netlens.operators import count_hourly, share_hourly
from netlens.sources.zeek import read_log
from netlens.streaming import features_stream, read_log_stream
from netlens.streaming.hourly import ZEEK_FIELD_ORDER


def _dns_file(path, rows):
    f = ZEEK_FIELD_ORDER["dns"]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("#separator \\x09\n#fields\t" + "\t".join(f) + "\n")
        for ts, src, rcode, rd, qtype, q in rows:
            vals = {"ts": ts, "id.orig_h": src, "rcode": rcode, "RD": rd, "qtype": qtype, "query": q}
            fh.write("\t".join(vals.get(x, "-") for x in f) + "\n")
        fh.write("#close\t2025\n")


def test_dns_stream_matches_batch(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "2025-01-09", "dns")
    _dns_file(os.path.join(root, "dns.1.log"), [
        ("1736380800.1", "10.0.0.1", "0", "T", "1", "a.example"),
        ("1736380900.2", "10.0.0.1", "3", "F", "16", "b.example"),
        ("1736384500.0", "10.0.0.2", "-", "T", "-", "a.example"),
    ])
    _dns_file(os.path.join(root, "dns.2.log"), [
        ("1736384600.0", "10.0.0.2", "0", "-", "28", "c.example"),
        ("1736388200.0", "-", "0", "T", "1", "d.example"),
    ])
    stream = features_stream(read_log_stream(spark, root, "dns"), "dns")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("dns_feat")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["id_orig_h"], r["hour"]): r for r in spark.sql("SELECT * FROM dns_feat").collect()}

    batch = read_log(spark, root, "dns")
    want = {(r["id_orig_h"], r["hour"]): r["failed_ratio"] for r in
            share_hourly(batch, "id_orig_h", P.not_equal_or_null("rcode", 0), "failed_ratio").collect()}
    assert set(got) == set(want) and len(want) == 2
    for k, v in want.items():
        assert abs(got[k]["dns_failed_ratio_hourly"] - v) < 1e-12
    rec = {(r["id_orig_h"], r["hour"]): r["count"]
           for r in count_hourly(batch, "id_orig_h", P.is_true("RD")).collect()}
    for k, r in got.items():
        assert r["dns_recursive_hourly"] == rec.get(k, 0)
    assert got[("10.0.0.1", min(k[1] for k in got))]["dns_unique_queries_hourly"] == 2
    # the stream and the batch feature table agree column by column (HLL is exact here)
    from netlens.plans.features import host_hour_features
    wide = {(r["id_orig_h"], r["hour"]): r.asDict() for r in host_hour_features(batch, "dns").collect()}
    assert {k: {c: v for c, v in r.asDict().items()} for k, r in got.items()} == wide


def _weird_file(path, rows):
    f = ZEEK_FIELD_ORDER["weird"]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("#fields\t" + "\t".join(f) + "\n")
        for ts, src in rows:
            vals = {"ts": ts, "id.orig_h": src, "name": "bad_TCP", "notice": "F"}
            fh.write("\t".join(vals.get(x, "-") for x in f) + "\n")


def test_watermark_drops_late_rows(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "weird")
    h0 = 1736380800  # 2025-01-09 00:00 UTC
    _weird_file(os.path.join(root, "weird.1.log"), [(str(h0 + 600), "a"), (str(h0 + 3 * 3600 + 60), "a")])
    q = (features_stream(read_log_stream(spark, root, "weird"), "weird", watermark="1 hour")
         .writeStream.outputMode("append").format("memory").queryName("weird_feat")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).start())
    try:
        q.processAllAvailable()
        # watermark is now 02:01: a row for hour 0 is late and must be dropped
        _weird_file(os.path.join(root, "weird.2.log"), [(str(h0 + 1200), "a"), (str(h0 + 6 * 3600), "a")])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["hour"].hour, r["weird_events_hourly"]) for r in spark.sql("SELECT * FROM weird_feat").collect()}
    assert (0, 1) in got and (0, 2) not in got
    assert (3, 1) in got


def test_start_stream_to_parquet(spark, tmpdir_path):
    from netlens.streaming import start_stream
    root = os.path.join(tmpdir_path, "weird")
    h0 = 1736380800
    _weird_file(os.path.join(root, "weird.1.log"), [(str(h0 + 60), "a"), (str(h0 + 5 * 3600), "b")])
    out = os.path.join(tmpdir_path, "out")
    # a fresh name: the default checkpoint lives under spark.checkpoint.dir, where a stream
    # of the same name resumes from its earlier run
    name = "weird_out_" + os.path.basename(tmpdir_path).replace("-", "_")
    q = start_stream(features_stream(read_log_stream(spark, root, "weird"), "weird"), out, name,
                     trigger="1 second")
    try:
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(out).collect()
    assert [(r["id_orig_h"], r["weird_events_hourly"]) for r in rows] == [("a", 1)]


def test_stream_over_landed_parquet(spark, tmpdir_path):
    from netlens.sources.ingest import land
    from netlens.streaming import read_landed_stream
    root = os.path.join(tmpdir_path, "raw", "2025-01-09", "dns")
    _dns_file(os.path.join(root, "dns.1.log"), [
        ("1736380800.1", "10.0.0.1", "0", "T", "1", "a.example"),
        ("1736380900.2", "10.0.0.1", "3", "F", "16", "b.example"),
    ])
    batch = read_log(spark, os.path.join(tmpdir_path, "raw"), "dns")
    landed = os.path.join(tmpdir_path, "landed")
    land(batch, landed)
    schema = spark.read.parquet(landed).schema
    stream = features_stream(read_landed_stream(spark, landed, schema, "dns"), "dns")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("landed_feat")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.sql("SELECT * FROM landed_feat").collect()
    assert [(r["id_orig_h"], r["dns_failed_ratio_hourly"], r["dns_recursive_hourly"]) for r in rows] \
        == [("10.0.0.1", 0.5, 1)]


import pytest  # noqa: E402


@pytest.mark.parametrize("log_type", ["dns", "files", "http", "kerberos", "ssl", "weird"])
def test_features_stream_equals_batch_on_driver_data(spark, tmpdir_path, log_type):
    """Each log view (sf0.001) written as Parquet and consumed as a stream gives the batch
    feature table (HyperLogLog is exact at these group sizes)."""
    from netlens.plans.features import host_hour_features
    from netlens.sources.views import log_view
    from netlens.streaming import features_stream
    src = os.path.join(tmpdir_path, "src")
    log_view(spark, "/root/testdata/sf0.001", log_type).write.parquet(src)
    static = spark.read.parquet(src)
    name = f"feat_{log_type}_" + os.path.basename(tmpdir_path).replace("-", "_")
    q = (features_stream(spark.readStream.schema(static.schema).parquet(src), log_type)
         .writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.sql(f"SELECT * FROM {name}").collect()), key=str)
    want = sorted(map(tuple, host_hour_features(static, log_type).collect()), key=str)
    assert got == want
