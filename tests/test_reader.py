"""The raw Zeek file fixture of FIXTURES.md §2 and the ingest operators."""

import datetime as dt
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from netlens.sources import ingest
from netlens.sources.sinks import export_csv, write_report
from netlens.sources.zeek import read_log, read_log_declared

HEADER = ("#separator \\x09\n#unset_field\t-\n#path\tconn\n"
          "#fields\tts\tid.orig_h\tflag\tdur\turi\n#types\ttime\taddr\tbool\tinterval\tstring\n")
BODY = "1736400000.5\t1.1.1.1\tT\t0.5\t/a#b\n1736411000.25\t1.1.1.2\t-\t-\t\"q\n#close\t2025\n"


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_raw_fixture(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.00_00_00-01_00_00.log", HEADER + BODY)
    df = read_log(spark, tmpdir_path, "conn")
    rows = df.orderBy("ts").collect()
    assert len(rows) == 2
    assert [r["uri"] for r in rows] == ["/a#b", '"q']
    assert [r["flag"] for r in rows] == [True, None]
    assert [r["dur"] for r in rows] == [0.5, None]
    assert rows[0]["ts"] == dt.datetime(2025, 1, 9, 5, 20, 0, 500000)
    assert rows[1]["ts"] == dt.datetime(2025, 1, 9, 8, 23, 20, 250000)
    assert rows[0]["id_orig_h"] == "1.1.1.1"
    assert rows[0]["log_type"] == "conn" and rows[0]["log_date"] == dt.date(2025, 1, 9)


def test_header_only_and_union_by_name(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.a.log", HEADER + "#close\t2025\n")
    _write(tmpdir_path, "2025-01-09/conn/conn.b.log", HEADER + BODY)
    other = HEADER.replace("#fields\tts\tid.orig_h\tflag\tdur\turi",
                           "#fields\tts\tid.orig_h\tproto")
    _write(tmpdir_path, "2025-01-09/conn/conn.c.log", other + "1736400001\t2.2.2.2\ttcp\n")
    _write(tmpdir_path, "2025-01-09/conn/dns.x.log", HEADER + BODY)  # other type: not read
    df = read_log(spark, tmpdir_path, "conn")
    assert df.count() == 3
    assert {"uri", "proto", "dur"} <= set(df.columns)
    r = df.where(F.col("id_orig_h") == "2.2.2.2").first()
    assert r["proto"] == "tcp" and r["uri"] is None


def test_salted_join_path(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.b.log", HEADER + BODY)
    df = read_log(spark, tmpdir_path, "conn", broadcast_header_bytes=0)
    assert df.count() == 2


def test_empty_folder_and_missing_path(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "empty"))
    df = read_log(spark, os.path.join(tmpdir_path, "empty"), "conn")
    assert df.count() == 0 and "id_orig_h" in df.columns
    with pytest.raises(AnalysisException):
        read_log(spark, os.path.join(tmpdir_path, "nothing"), "conn")


def test_type_from_folder(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-11/nested/dns/dns.1.log",
           HEADER.replace("conn", "dns") + BODY)
    df = read_log(spark, tmpdir_path)
    assert [r["log_type"] for r in df.collect()] == ["dns", "dns"]


def test_file_without_header_is_refused_by_name(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.a.log", HEADER + BODY)
    _write(tmpdir_path, "2025-01-09/conn/conn.bare.log", BODY)
    with pytest.raises(ValueError, match="conn.bare.log .no #fields line"):
        read_log(spark, tmpdir_path, "conn")


def test_file_with_two_headers_is_refused_by_name(spark, tmpdir_path):
    swapped = HEADER.replace("#fields\tts\tid.orig_h", "#fields\tid.orig_h\tts")
    _write(tmpdir_path, "2025-01-09/conn/conn.two.log", HEADER + BODY + swapped + "1.1.1.9\t1736400000.5\tT\t1\tx\n")
    with pytest.raises(ValueError, match="conn.two.log .2 different #fields lines"):
        read_log(spark, tmpdir_path, "conn")
    _write(tmpdir_path, "again/conn/conn.same.log", HEADER + BODY + HEADER + BODY)  # the same header twice
    assert read_log(spark, os.path.join(tmpdir_path, "again"), "conn").count() == 4


def test_later_header_fails_the_scan_by_name(spark, tmpdir_path):
    """A header that changes after the leading lines is found by the one scan of the data."""
    swapped = HEADER.replace("#fields\tts\tid.orig_h", "#fields\tid.orig_h\tts")
    line = BODY.splitlines()[0] + "\n"
    _write(tmpdir_path, "2025-01-09/conn/conn.late.log", HEADER + line * 5000 + swapped + "1.1.1.9\t1736400000.5\tT\t1\tx\n")
    _write(tmpdir_path, "2025-01-09/conn/conn.ok.log", HEADER + line * 5000 + HEADER + line)
    df = read_log(spark, tmpdir_path, "conn")  # the header pass does not reach the line
    with pytest.raises(Exception, match="conn.late.log: different #fields lines: #fields.id.orig_h"):
        df.count()
    os.makedirs(os.path.join(tmpdir_path, "ok"))
    ok = read_log(spark, tmpdir_path, "conn", pattern="conn.ok.log")
    assert ok.count() == 5001


def test_header_pass_reads_only_the_head(spark, tmpdir_path):
    from netlens.sources.zeek import HEAD_LINES, file_heads
    line = BODY.splitlines()[0] + "\n"
    for k in range(5):  # in one folder: each has a task of its own
        _write(tmpdir_path, f"2025-01-09/conn/conn.{k}.log", HEADER + line * 100_000)
    _write(tmpdir_path, "2025-01-09/conn/conn.comments.log", "# nothing yet\n" * 3000 + HEADER + line)
    _write(tmpdir_path, "2025-01-09/conn/conn.late.log", "# nothing yet\n" * 3000 + line)
    heads = {os.path.basename(r["src_file"]): r for r in file_heads(spark, tmpdir_path, "conn").collect()}
    assert len(heads) == 7 and all(heads[f"conn.{k}.log"]["n_data"] < HEAD_LINES for k in range(5))
    assert heads["conn.comments.log"]["fields"] == ["ts", "id.orig_h", "flag", "dur", "uri"]
    assert heads["conn.late.log"]["fields"] is None and heads["conn.late.log"]["n_data"] == 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 40)  # the caller's settings stay
    with pytest.raises(ValueError, match="conn.late.log .no #fields line"):
        read_log(spark, tmpdir_path, "conn")
    plan = read_log(spark, tmpdir_path, "conn", pattern="conn.?.log")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_list_files_in_tasks(spark, tmpdir_path):
    from netlens.sources.zeek import list_files
    for rel in ("a.log", "2025-01-09/conn/x y+é%41.log", "2025-01-09/conn/empty.log", "2025-01-10/b.txt", "_tmp/c.log", "d/.h.log"):
        _write(tmpdir_path, rel, "" if "empty" in rel else "1\n")
    for root in (tmpdir_path, "file:" + tmpdir_path, "file://" + tmpdir_path + "/"):
        got = {r["src_file"].partition(tmpdir_path)[2]: r["file_size"] for r in list_files(spark, root).collect()}
        assert got == {"/a.log": 2, "/2025-01-09/conn/x y+é%41.log": 2, "/2025-01-09/conn/empty.log": 0}


def test_declared_order_is_compared(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.b.log", HEADER + BODY)
    assert read_log_declared(spark, tmpdir_path, "conn", ["ts", "id.orig_h", "flag"]).count() == 2  # more columns follow
    with pytest.raises(Exception, match="conn.b.log: its #fields line does not begin with the declared fields"):
        read_log_declared(spark, tmpdir_path, "conn", ["id.orig_h", "ts", "flag"]).count()


def test_column_order_changes_between_files(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.a.log", "#fields\tts\tproto\tid.orig_h\n1736400000.5\ttcp\t1.1.1.1\n")
    _write(tmpdir_path, "2025-01-09/conn/conn.b.log", "#fields\tid.orig_h\tts\tproto\n1.1.1.2\t1736400000.5\tudp\n")
    got = sorted((r["id_orig_h"], r["proto"]) for r in read_log(spark, tmpdir_path, "conn").collect())
    assert got == [("1.1.1.1", "tcp"), ("1.1.1.2", "udp")]


def test_classify_names(spark):
    names = ["/x/2025-01-09/conn.12%3A00%3A00-13%3A00%3A00.log", "/x/2025-01-09/a+b%zz.log. ",
             "/x/2025-01-09/weird%2Fname.log"]
    df = ingest.classify(spark.createDataFrame([(n,) for n in names], "path string"))
    got = [(r["clean_name"], r["log_type"], r["log_date"]) for r in df.collect()]
    assert got[0] == ("conn.12_00_00-13_00_00.log", "conn", "2025-01-09")
    assert got[1] == ("a+b%zz.log", "a+b%zz", "2025-01-09")
    assert got[2] == ("weird_name.log", "weird_name", "2025-01-09")


def test_schema_score(spark, tmpdir_path):
    good = "#fields\t" + "\t".join(["ts", "id.orig_h", "id.resp_h", "name", "notice", "source"]) + "\n"
    _write(tmpdir_path, "2025-01-09/weird/weird.1.log", good + "1\ta\tb\tn\tT\tx\n")
    _write(tmpdir_path, "2025-01-09/weird/weird.2.log", "#fields\tts\tname\n1\tn\n")
    _write(tmpdir_path, "2025-01-09/weird/weird.3.log", "1\tn\n")  # no header: counts, and fails
    _write(tmpdir_path, "2025-01-09/weird/weird.4.log", "")
    r = ingest.schema_score(spark, tmpdir_path).first()
    assert (r["n_files"], r["n_ok"], r["score"]) == (4, 1, 0.25)
    bad = {os.path.basename(x["src_file"]): list(x["missing"]) for x in ingest.schema_conformance(spark, tmpdir_path).collect() if not x["ok"]}
    assert len(bad["weird.3.log"]) == 6 and "source" in bad["weird.2.log"]
    os.makedirs(os.path.join(tmpdir_path, "none"))
    assert ingest.schema_score(spark, os.path.join(tmpdir_path, "none")).first()["score"] is None


def test_land_idempotent_and_export(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "raw")
    _write(src, "2025-01-09/conn/conn.b.log", HEADER + BODY)
    df = read_log(spark, src, "conn")
    out = os.path.join(tmpdir_path, "landed")
    ingest.land(df, out)
    ingest.land(df, out)
    back = ingest.read_landed(spark, out, "conn", ["2025-01-09"])
    assert back.count() == 2
    assert "uri" not in back.columns and ingest.read_landed(spark, out, "conn", all_columns=True).select("uri").count() == 2
    csv = os.path.join(tmpdir_path, "csv")
    derived = os.path.join(tmpdir_path, "csv2")
    export_csv(spark.createDataFrame([(1.5, 100, 4)], "duration double, orig_bytes long, orig_pkts long"), derived, "conn")
    r = spark.read.option("header", True).csv(derived).first()
    assert (float(r["duration_seconds"]), float(r["bytes_per_pkt"])) == (1.5, 20.0)
    export_csv(df.select("ts", "id_orig_h"), csv, "conn")
    assert spark.read.option("header", True).csv(csv).columns == ["ts", "id.orig_h"]
    written = write_report({"shape": df.groupBy().count()}, os.path.join(tmpdir_path, "rep"))
    assert spark.read.parquet(written[0]).first()[0] == 2


def test_declared_layout_one_scan(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.b.log", HEADER + BODY)
    df = read_log_declared(spark, tmpdir_path, "conn", ["ts", "id.orig_h", "flag", "dur", "uri"])
    want = read_log(spark, tmpdir_path, "conn")
    cols = ["ts", "id_orig_h", "uri", "log_date"]
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_gzipped_archives(spark, tmpdir_path):
    import gzip
    p = os.path.join(tmpdir_path, "2025-01-09", "conn", "conn.00_00_00-01_00_00.log.gz")
    os.makedirs(os.path.dirname(p))
    with gzip.open(p, "wt") as f:
        f.write(HEADER + BODY)
    assert read_log(spark, tmpdir_path, "conn").count() == 0  # the default glob is *.log
    df = read_log(spark, tmpdir_path, "conn", pattern="conn*.log.gz")
    assert sorted(r["uri"] for r in df.collect()) == ['"q', "/a#b"]


def test_truncated_line_reads_missing_fields_as_null(spark, tmpdir_path):
    _write(tmpdir_path, "2025-01-09/conn/conn.t.log", HEADER + "1736400000.5\t1.1.1.1\tT\n")
    r = read_log(spark, tmpdir_path, "conn").first()
    assert r["id_orig_h"] == "1.1.1.1" and r["flag"] is True and r["dur"] is None and r["uri"] is None


def test_empty_marker_is_empty_string(spark, tmpdir_path):
    from netlens.plans.http import proxied_ratio_hourly
    head = "#separator \\x09\n#unset_field\t-\n#empty_field\t(empty)\n#fields\tts\tid.orig_h\tproxied\tstatus_code\n"
    body = "1736400000.5\t1.1.1.1\t(empty)\t(empty)\n1736400001.5\t1.1.1.1\tVIA\t200\n1736400002.5\t1.1.1.1\t-\t-\n"
    _write(tmpdir_path, "2025-01-09/http/http.1.log", head + body)
    df = read_log(spark, tmpdir_path, "http")
    assert sorted((r["proxied"] is None, r["proxied"]) for r in df.collect()) == \
        [(False, ""), (False, "VIA"), (True, None)]
    assert [r["status_code"] for r in df.orderBy("ts").collect()] == [None, 200, None]
    assert proxied_ratio_hourly(df).first()["proxied_ratio"] == 1 / 3


def test_heads_of_files_that_share_a_task(spark, tmp_path):
    from netlens.sources import zeek
    for k in range(6):
        cols = ["ts", "uid"][::1 if k % 2 else -1]
        (tmp_path / f"dns.{k}.log").write_text("#fields\t" + "\t".join(cols) + "\n" + "1\t2\n" * 1500)
    lines = zeek._scan(spark, str(tmp_path), "dns", True, None).coalesce(1)
    got = lines.mapInArrow(zeek._head(False), zeek._HEADS).collect()
    assert sorted((r[zeek.SRC][-5], r.layouts) for r in got) == [(str(k), [["ts", "uid"][::1 if k % 2 else -1]]) for k in range(6)]
    assert all(0 < r.n_data < 1500 for r in got)
