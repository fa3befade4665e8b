"""Reading rotated Zeek TSV logs into typed DataFrames.

File layout: ``<root>/<date>/<log_type>/<log_type>.<from>-<to>.log``. A file is
tab-separated; lines starting with ``#`` are metadata, ``#fields`` names the
columns of THAT file, ``-`` is NULL. Different files may carry different
columns; the result is their union by name, with gaps as NULL.

Plan: a first pass reads only the leading lines of every file (one task per file, which
stops reading there) and yields one header row per file, written to the shared folder and
measured. Files that begin with data, and files whose leading lines hold different ``#fields``
lines, are refused by name. The data scan, the only full one, joins each line with its file's
header and picks each column by its position there: broadcast when the measured header table is
small, otherwise a salted shuffle join, with as many salts as the largest file needs, so that one
huge file does not land in one task. The same scan compares every later ``#fields`` line with
the file's header and fails with the file's name where they differ, or where a file has data but
no header. Values are then cast to the declared types.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as Z
from ..session import checkpoint_dir

SRC, SIZE, PLACES, VALS, LINE = "src_file", "file_size", "__places", "__vals", "__line"
BROADCAST_HEADER_BYTES = 64 << 20
HEAD_LINES = 1000  # leading lines of a file that the header pass looks at
BYTES_PER_SALT = 128 << 20


def scan_lines(spark: SparkSession, path: str, log_type: str | None = None, recursive: bool = True,
               pattern: str | None = None) -> DataFrame:
    """(value, src_file, file_size): the lines of the matching files. A path that does not
    exist is an error; a folder without matching files has no lines."""
    return _scan(spark, path, log_type, recursive, pattern).drop("start")


def _scan(spark: SparkSession, path: str, log_type: str | None, recursive: bool, pattern: str | None) -> DataFrame:
    glob = pattern or (f"{log_type}*.log" if log_type else "*.log")
    return (spark.read.option("recursiveFileLookup", str(recursive).lower())
            .option("pathGlobFilter", glob).text(path)
            .select("value", F.col("_metadata.file_path").alias(SRC), F.col("_metadata.file_size").alias(SIZE),
                    F.col("_metadata.file_block_start").alias("start")))


def _meta(prefix: str) -> Column:
    v = F.col("value")
    return F.when(v.startswith(prefix + "\t"),
                  F.split(F.regexp_replace(v, "^" + prefix + "\t", ""), "\t"))


def header_table(lines: DataFrame) -> DataFrame:
    """One row per file that has a line: src_file, file_size, layouts (its different
    ``#fields`` lines), fields (the only one, else NULL), types, n_data. One partial row per
    file and task reaches the shuffle. For lines that are no file scan; see ``file_heads``."""
    is_data = ~F.col("value").startswith("#") & (F.col("value") != "")
    h = lines.groupBy(SRC).agg(F.max(SIZE).alias(SIZE), F.collect_set(_meta("#fields")).alias("layouts"),
                               F.max(_meta("#types")).alias("types"), F.count_if(is_data).alias("n_data"))
    return _with_fields(h)


def _with_fields(h: DataFrame) -> DataFrame:
    return h.withColumn("fields", F.when(F.size("layouts") == 1, F.get("layouts", F.lit(0))))


_HEADS = f"{SRC} string, {SIZE} bigint, layouts array<array<string>>, types array<string>, n_data bigint"


def _head(alone: bool):
    """The header rows of the files whose lines the task reads, from their leading lines: the first
    ``HEAD_LINES``, and later ones up to a line that is data or names the fields. A task that has
    its file ``alone`` returns then, which ends the reading; else it passes over the file's other lines."""
    schema = pa.schema([(SRC, pa.string()), (SIZE, pa.int64()), ("layouts", pa.list_(pa.list_(pa.string()))),
                        ("types", pa.list_(pa.string())), ("n_data", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, n = None, 0
        for b in batches:
            for value, file, length, start in zip(*(b.column(i).to_pylist() for i in range(4))):
                if start:  # a later split of a file
                    continue
                if row is None or row[SRC] != file:
                    if row is not None:
                        yield pa.RecordBatch.from_pylist([row], schema=schema)
                    row, n = {SRC: file, SIZE: length, "layouts": [], "types": None, "n_data": 0}, 0
                n += 1
                if n > HEAD_LINES and (row["layouts"] or row["n_data"]):
                    continue
                name, _, rest = value.partition("\t")
                if name == "#fields" and rest.split("\t") not in row["layouts"]:
                    row["layouts"].append(rest.split("\t"))
                elif name == "#types":
                    row["types"] = max(row["types"] or [], rest.split("\t"))
                row["n_data"] += value != "" and not value.startswith("#")
            if alone and (row is None or (n >= HEAD_LINES and (row["layouts"] or row["n_data"]))):
                break
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def file_heads(spark: SparkSession, path: str, log_type: str | None = None, recursive: bool = True,
               pattern: str | None = None) -> DataFrame:
    """``header_table`` of the matching files from their leading lines only (n_data counts those).

    The pass runs in a session of its own, whose settings give every file a task of its own, in
    batches of a few lines; a task that has seen enough returns, and the rest of its file is not
    read. Where a cluster pins other settings, tasks read several files, to their ends. Its rows are written to the shared folder (they survive lost executors)."""
    own = spark.newSession()
    one_file = str(1 << 40)
    for k, v in {"spark.sql.files.maxPartitionBytes": one_file, "spark.sql.files.openCostInBytes": one_file,
                 "spark.sql.files.maxPartitionNum": str((1 << 31) - 1),
                 "spark.sql.execution.arrow.maxRecordsPerBatch": str(HEAD_LINES)}.items():
        own.conf.set(k, v)
    lines = _scan(own, path, log_type, recursive, pattern)
    at = f"{checkpoint_dir(spark).rstrip('/')}/heads-{uuid.uuid4().hex}"
    alone = own.conf.get("spark.sql.files.openCostInBytes") == own.conf.get("spark.sql.files.maxPartitionBytes") == one_file
    lines.mapInArrow(_head(alone), _HEADS).write.parquet(at)
    return _with_fields(spark.read.schema(_HEADS).parquet(at))


def refuse_unreadable(headers: DataFrame) -> None:
    """Raises, naming files, where data lines have no header or more than one."""
    bad = headers.where((F.size("layouts") > 1) | ((F.size("layouts") == 0) & (F.col("n_data") > 0)))
    some = bad.select(SRC, F.size("layouts").alias("n")).orderBy(SRC).take(20)  # names for the message
    if some:
        names = ", ".join(f"{r[SRC]} ({'no #fields line' if not r['n'] else str(r['n']) + ' different #fields lines'})" for r in some)
        raise ValueError(f"{bad.count()} files cannot be read by one header: {names}")


# Zeek type names -> our column kinds.
ZEEK_TYPES = {"time": Z.TS, "interval": Z.DBL, "double": Z.DBL, "count": Z.LONG, "int": Z.LONG,
              "port": Z.INT, "bool": Z.BOOL}


def _kind(log_type: str | None, field: str, zeek_types: set) -> str:
    declared = Z.FIELDS.get(log_type or "", {}).get(field) or Z.COMMON.get(field)
    if declared:
        return declared
    kinds = {ZEEK_TYPES.get(t, Z.STR) for t in zeek_types if t}
    return kinds.pop() if len(kinds) == 1 else Z.STR


def path_part(from_end: int) -> Column:
    """Folder name ``from_end`` levels above the file (1 = parent)."""
    return F.element_at(F.split(F.col(SRC), "/"), -1 - from_end)


# Zeek's markers for an unset field and for an empty set / string.
UNSET_FIELD = "-"
EMPTY_FIELD = "(empty)"


def _convert(raw: Column, kind: str) -> Column:
    """Raw text -> typed value: the unset marker is NULL; the empty marker is ''
    for strings (an empty set or string) and NULL for typed columns."""
    v = F.when(raw != UNSET_FIELD, raw)
    if kind == Z.STR:
        return F.when(v == EMPTY_FIELD, F.lit("")).otherwise(v)
    v = F.when(v != EMPTY_FIELD, v)
    if kind == Z.TS:
        return F.timestamp_seconds(v.try_cast("decimal(20,6)"))
    if kind == Z.BOOL:
        return F.when(v == "T", F.lit(True)).when(v == "F", F.lit(False))
    if kind in (Z.INT, Z.LONG, Z.DBL):
        return v.try_cast(kind)
    return v


def _empty(spark: SparkSession, log_type: str | None) -> DataFrame:
    from pyspark.sql import types as T
    st = Z.struct_for(log_type) if log_type in Z.REQUIRED else T.StructType(
        [T.StructField("ts", T.TimestampType())])
    st = st.add(SRC, T.StringType()).add("log_type", T.StringType()).add("log_date", T.DateType())
    return spark.createDataFrame([], st)


def declared_columns(log_type: str, fields: Sequence[str], kind) -> tuple[Column, list[Column]]:
    """For lines whose columns stand in the order of ``fields``: a filter that keeps the data lines
    and fails, with the file's name, at a ``#fields`` line that begins otherwise; and the typed
    columns. ``kind(field)`` names a field's type."""
    v, want = F.col("value"), "#fields\t" + "\t".join(fields)
    told = F.concat(F.col(SRC), F.lit(": its #fields line does not begin with the declared fields: "), v)
    header = v.startswith("#fields\t")
    keep = F.when(header & (v != want) & ~v.startswith(want + "\t"), F.raise_error(told).cast("boolean")) \
        .otherwise(~v.startswith("#") & (v != ""))
    vals = F.split(v, "\t", -1)
    return keep, [_convert(F.get(vals, F.lit(i)), kind(f)).alias(Z.canonical(f)) for i, f in enumerate(fields)]


def read_log_declared(spark: SparkSession, path: str, log_type: str, fields: list[str],
                      recursive: bool = True) -> DataFrame:
    """Reader for a fixed Zeek configuration: columns by position in ``fields``, no header pass.
    The scan compares every ``#fields`` line with them: a file with another order fails by name
    (more columns after the declared ones are left out)."""
    keep, cols = declared_columns(log_type, fields, lambda f: _kind(log_type, f, set()))
    return scan_lines(spark, path, log_type, recursive).where(keep).select(
        *cols, SRC, F.lit(log_type).alias("log_type"), path_part(2).try_cast("date").alias("log_date"))


def read_log(spark: SparkSession, path: str, log_type: str | None = None, recursive: bool = True,
             broadcast_header_bytes: int = BROADCAST_HEADER_BYTES,
             pattern: str | None = None) -> DataFrame:
    """All ``<log_type>*.log`` files under ``path`` as one typed DataFrame.

    ``pattern`` overrides the file-name glob, e.g. ``"conn*.log.gz"`` for
    compressed archives (decompressed by extension; one task per such file).
    ``log_type=None`` reads every ``*.log`` and takes the type from the parent
    folder (S7). Folders without matching files and header-only files give no
    rows; a path that does not exist is an error. A file whose columns change after its leading
    lines fails the scan by name.
    """
    return parse_lines(scan_lines(spark, path, log_type, recursive, pattern),
                       file_heads(spark, path, log_type, recursive, pattern), log_type, broadcast_header_bytes)


def parse_lines(lines: DataFrame, headers: DataFrame, log_type: str | None = None,
                broadcast_header_bytes: int = BROADCAST_HEADER_BYTES) -> DataFrame:
    """Typed rows of ``lines`` (value, src_file, file_size) by ``headers``, their files' header
    rows (``file_heads``); see ``read_log``."""
    spark = lines.sparkSession
    refuse_unreadable(headers)
    headers = headers.where(F.col("fields").isNotNull())
    meas = headers.agg(F.count(F.lit(1)).alias("n"), F.max(SIZE).alias("largest"),
                       F.sum(F.length(F.concat_ws("\t", "fields")) + F.length(SRC)).alias("b")).first()
    if not meas["n"]:
        return _empty(spark, log_type)
    # the result's columns: each name once, in order of its first place in a header
    named = headers.select(F.posexplode("fields").alias("at", "f"), "types") \
        .select("f", "at", F.get("types", F.col("at")).alias("t"))
    names = named.groupBy("f").agg(F.min("at").alias("at"), F.collect_set("t").alias("ts")).orderBy("at", "f").collect()

    # per file: where each of the names stands in its lines (NULL: not there)
    place = lambda f: F.nullif(F.array_position("fields", F.lit(f)), F.lit(0).cast("bigint")).cast("int") - 1
    hdr = headers.select(SRC, F.array(*[place(r["f"]) for r in names]).alias(PLACES),
                         F.concat(F.lit("#fields\t"), F.array_join("fields", "\t")).alias(LINE))
    v = F.col("value")
    data = lines.where((v != "") & (~v.startswith("#") | v.startswith("#fields\t"))).select(SRC, "value")
    if meas["b"] <= broadcast_header_bytes:
        joined = data.join(F.broadcast(hdr), SRC, "left")
    else:
        # each header row is replicated once per salt and data rows pick one copy by hash, so
        # the rows of the largest file spread over reducers of about BYTES_PER_SALT
        salts = max(1, -(-int(meas["largest"] or 0) // BYTES_PER_SALT))
        joined = (data.withColumn("__salt", F.pmod(F.xxhash64("value"), F.lit(salts)))
                  .join(hdr.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))),
                        [SRC, "__salt"], "left").drop("__salt"))
    told = lambda what: F.raise_error(F.concat(F.col(SRC), F.lit(f": {what}: "), v)).cast("boolean")
    header = v.startswith("#fields\t")
    joined = joined.where(F.when(F.col(LINE).isNull(), told("no #fields line at its beginning"))
                          .when(header & (v != F.col(LINE)), told("different #fields lines")).otherwise(~header)) \
        .withColumn(VALS, F.split("value", "\t", -1))
    cols = []
    for k, r in enumerate(names):
        raw = F.get(VALS, F.get(PLACES, F.lit(k)))
        cols.append(_convert(raw, _kind(log_type, r["f"], set(r["ts"]))).alias(Z.canonical(r["f"])))
    ltype = F.lit(log_type) if log_type else path_part(1)
    return joined.select(*cols, F.col(SRC), ltype.alias("log_type"), path_part(2).try_cast("date").alias("log_date"))


def log_shape(df: DataFrame) -> DataFrame:
    """S13 on a read log: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def _below(folders: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uri, size of the files below each (store, path) row."""
    from pyarrow import fs
    for b in folders:
        for store, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = fs.FileSystem.from_uri(store)[0]
            found = [x for x in at.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file]
            yield pa.RecordBatch.from_arrays([pa.array([x.path for x in found], pa.string()),
                                              pa.array([x.size for x in found], pa.int64())], names=[SRC, SIZE])


def list_files(spark: SparkSession, root: str, suffix: str = ".log") -> DataFrame:
    """(src_file, file_size) of the files below ``root`` whose names end in ``suffix``, empty ones
    included. The driver lists the entries of ``root`` itself (folders of days); each folder is
    listed by a task. Paths are not percent-encoded. Hidden files (``_``, ``.``) are left out, as by
    Spark's readers."""
    from pyarrow import fs
    uri = root if "://" in root else "file://" + quote("/" + root.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    top = store.get_file_info(fs.FileSelector(path))
    prefix = uri[:uri.index("://") + 3] + uri[uri.index("://") + 3:].partition("/")[0]
    folders = [(f"{prefix}/", x.path) for x in top if not x.is_file]
    files = spark.createDataFrame([(x.path, x.size) for x in top if x.is_file], f"{SRC} string, {SIZE} bigint")
    if folders:
        rows = spark.createDataFrame(folders, "store string, path string").repartition(min(len(folders), 1000))
        files = files.unionByName(rows.mapInArrow(_below, f"{SRC} string, {SIZE} bigint"))
    inner = F.substring(SRC, len(path.rstrip("/")) + 1, 1 << 20)
    return files.where(F.col(SRC).endswith(suffix) & ~inner.rlike("/[._]")) \
        .select(F.concat(F.lit(prefix), F.when(F.col(SRC).startswith("/"), "").otherwise("/"), F.col(SRC)).alias(SRC), SIZE)


def missing_columns(df: DataFrame, log_type: str) -> list[str]:
    """The columns that the analytics of ``log_type`` read and ``df`` lacks."""
    return [f.name for f in Z.struct_for(log_type).fields if f.name not in df.columns]


def conform(df: DataFrame, log_type: str, allow_missing: bool = False) -> DataFrame:
    """``df`` if it has every column the analytics of ``log_type`` read. Otherwise an error that
    names the absent ones; with ``allow_missing`` a warning that names them, and they are added
    as typed NULLs."""
    absent = missing_columns(df, log_type)
    if not absent:
        return df
    if not allow_missing:
        raise ValueError(f"{log_type} log lacks the columns {absent}")
    warnings.warn(f"{log_type} log lacks the columns {absent}; they are read as NULL", stacklevel=2)
    st = Z.struct_for(log_type)
    return df.select("*", *[F.lit(None).cast(st[c].dataType).alias(c) for c in absent])


def stack_logs(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side are NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
