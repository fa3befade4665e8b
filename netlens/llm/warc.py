"""WARC archives: writing, and reading back by boundary-chain verification (operator 5).

Writing: every page becomes one record. Of records with equal payloads of ``MIN_REVISIT``
bytes or more, the one with the largest page_id is the response and the others are revisits
that refer to it and hold no payload. Spark's text writer makes the files, with the record
end ``CRLF CRLF`` as its line separator, so archives are written by tasks into any file
system Spark knows, and retried like any other output.

Reading: archives are split anywhere, and a payload may hold the magic line itself.
1. The scan cuts the bytes at every magic line, wherever it stands; each piece is a candidate
   record with its offset and, by its Content-Length, the offset where its successor must be.
   Only these numbers leave the scan.
2. Candidates of one block of an archive follow their successors in a task (pointer jumping
   on arrays) to the offset where each chain leaves the block.
3. Chains are followed from block to block by pointer doubling from the start of the file;
   only the candidates at which chains enter a block take part.
4. A second pass inside the blocks keeps the candidates that the chain from the file's start
   reaches. Magic lines inside payloads are not reached, so they are no records.
Payloads that span several pieces are put together again per record.

Defined results: null html is an empty payload; a null page_id is written without a number and
comes back as null (with equal payloads it ranks below every number; where all are null, all
are responses); rows that tie for the largest page_id are all responses; a null url is left
out; extra columns are ignored; an empty table gives no archive rows. A file that does not
begin with the magic line has no records; a chain ends where no record starts. A record whose
payload would end past the end of its file (the file is cut short, or the length is wrong) is no
record. Records of 2 GB or more fit no value and stop the reading with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, stored, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
MIN_REVISIT = 1000
BROADCAST_ROWS = 100_000
BLOCK = 8 << 20  # bytes of an archive whose candidates one task follows


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   min_revisit: int = MIN_REVISIT) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC records, one archive per task."""
    p = pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))) \
        .withColumn("bytes", F.octet_length("html"))
    first = p.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL") \
        .select("digest", "bytes", "keeper")
    p = p.join(_small(cut(first)), ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    number = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block_bytes = F.lit(len(HTTP + END)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), number("page_id"), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: "), number("keeper"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_bytes.cast("string"), F.lit(END))
    record = F.concat(head, F.lit(HTTP + END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast in joins if its counted rows (numbers and digests) are few; otherwise
    the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, split, value, n: the archive's bytes between magic lines, in file order."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        "value", F.octet_length("value").cast("bigint").alias("n"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``in_split``, the piece's offset in its split: a task reads a split's pieces in
    order, so this is a running sum over its batches, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for k, (path, split, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "split", "n")))):
                if (path, split) not in at:
                    at = {(path, split): 0}
                out[k] = at[path, split]
                at[path, split] += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "in_split"])

    schema = pieces.select("*", F.lit(0).cast("bigint").alias("in_split")).schema
    return pieces.mapInArrow(run, schema)


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, the offset in the file, from ``in_split`` and one row per split, and
    ``file_end``, the size of the file."""
    sums = pieces.groupBy("path", "split").agg(F.sum(F.col("n") + len(MAGIC)).alias("all"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # no magic line follows the last piece
    file_end = F.sum("all").over(Window.partitionBy("path")) - len(MAGIC)
    sums = sums.select("path", "split", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"), file_end.alias("file_end"))
    return pieces.join(sums, ["path", "split"]).withColumn("at", F.col("base") + F.col("in_split")).drop("base")


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of each piece and the digest of its payload, if the piece holds it all."""
    head = F.substring_index("value", END, 1)
    d = pieces.withColumn("head", head).withColumn("h", F.octet_length("head").cast("bigint"))
    d = d.withColumn("length", F.when(F.col("h") < F.col("n"), F.try_to_number(
        F.regexp_extract("head", r"(?:^|\n)Content-Length: (\d{1,18})\r?(?:\n|$)", 1), F.lit("9" * 18)).cast("bigint")))
    body = F.expr("substring(cast(value AS binary), cast(h + 5 AS int), cast(length AS int))")
    d = d.withColumn("body", F.when(F.col("length") + F.col("h") + len(END) <= F.col("n"), body))
    field = lambda name: F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    return d.select(
        "path", "split", "n", "h", "length", field("WARC-Type").alias("type"),
        F.regexp_extract("head", r"WARC-Record-ID: <urn:x-page:(-?\d*)>", 1).alias("page"),
        F.regexp_extract("head", r"WARC-Refers-To: <urn:x-page:(-?\d*)>", 1).alias("refers"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        *_payload(F.col("body")))


def _payload(body):
    """Bytes and SHA-1 of the payload of an HTTP block (null block: null)."""
    skip = F.octet_length(F.substring_index(body.cast("string"), END, 1)) + len(END)
    payload = F.substring(body, skip + 1, F.greatest(F.octet_length(body) - skip, F.lit(0)))
    return F.octet_length(payload).cast("bigint").alias("bytes"), F.sha1(payload).alias("sha1")


def _follow(at: np.ndarray, succ: np.ndarray, end: int) -> np.ndarray:
    """Index of the next candidate inside the block; a candidate that leaves it, or whose
    successor is no candidate, points to itself."""
    here = np.arange(len(at))
    i = np.minimum(np.searchsorted(at, succ), len(at) - 1)
    return np.where((succ < end) & (at[i] == succ) & (succ > at), i, here)


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("at", ignore_index=True)
    at, succ = g["at"].to_numpy(), g["succ"].to_numpy()
    to = _follow(at, succ, (int(g["block"].iat[0]) + 1) * BLOCK)
    while True:  # pointer jumping: chains of length 2, 4, 8, ...
        two = to[to]
        if np.array_equal(two, to):
            break
        to = two
    return pd.DataFrame({"path": g["path"], "at": at, "leaves": succ[to]})


def _reached(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("at", ignore_index=True)
    at = g["at"].to_numpy()
    to = _follow(at, g["succ"].to_numpy(), (int(g["block"].iat[0]) + 1) * BLOCK)
    seen = g["entry"].to_numpy().copy()
    while True:  # everything a reached candidate jumps to is reached; jumps double
        more = seen.copy()
        more[to[seen]] = True
        if np.array_equal(more, seen) and np.array_equal(to[to], to):
            break
        seen, to = more, to[to]
    return pd.DataFrame({"path": g["path"][seen], "at": at[seen]})


def reachable(candidates: DataFrame) -> DataFrame:
    """``candidates`` (path, at, succ) -> (path, at) of those on the chain from offset 0."""
    c = candidates.select("path", "at", "succ", F.floor(F.col("at") / BLOCK).alias("block"))
    exits = cut(c.groupBy("path", "block").applyInPandas(_exits, "path string, at bigint, leaves bigint"))
    # only candidates at which some chain enters a block, and file starts, matter from here
    doors = exits.select("path", F.col("leaves").alias("at")).distinct()
    jump = cut(exits.join(doors, ["path", "at"], "left_semi").unionByName(exits.where("at = 0")).distinct())
    seen = cut(exits.where("at = 0").select("path", "at"))
    known = seen.count()
    while True:
        to = jump.select("path", "at", F.col("leaves").alias("next"))
        new = seen.join(to, ["path", "at"]).select("path", F.col("next").alias("at"))
        seen = cut(seen.unionByName(new).distinct())
        now = seen.count()
        if now == known:
            break
        known = now
        mid = jump.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        jump = cut(jump.join(mid, ["path", "leaves"], "left").select("path", "at", F.coalesce("far", "leaves").alias("leaves")))
    marked = c.join(seen.withColumn("entry", F.lit(True)), ["path", "at"], "left") \
        .withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("path", "block").applyInPandas(_reached, "path string, at bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: path, at (offset), type, page_id, refers_to, digest (header), bytes
    and sha1 of the payload as read."""
    pieces = cut(_with_offsets(stored(_placed(_parsed(_pieces(spark, path))), "warc-pieces")))
    # a piece begins after its magic line; the first piece of a file is what stands before it
    cand = pieces.where(F.col("length").isNotNull() & (F.col("at") > 0)) \
        .withColumn("at", F.col("at") - len(MAGIC)) \
        .withColumn("succ", F.col("at") + len(MAGIC) + F.col("h") + F.col("length") + 2 * len(END)) \
        .where(F.col("succ") - len(END) <= F.col("file_end"))
    records = cand.join(reachable(cand), ["path", "at"], "left_semi")
    records = cut(records)
    numbers = [F.expr("try_cast(page AS bigint)").alias("page_id"), F.expr("try_cast(refers AS bigint)").alias("refers_to")]
    long = records.where("sha1 IS NULL").select("path", F.col("at").alias("start"), "succ", F.col("h").alias("rh"), F.col("length").alias("rl"))
    # pieces of records that span several: their places are known, their bytes are read again
    spread = long.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("succ") / BLOCK))))
    spots = pieces.select("path", "split", "in_split", (F.col("at") - len(MAGIC)).alias("at")) \
        .withColumn("block", F.floor(F.col("at") / BLOCK)).join(spread, ["path", "block"]).where("at >= start AND at < succ").drop("block")
    spots = cut(spots)
    if not spots.take(1):  # every record lies in one piece: nothing to read again
        return records.select("path", "at", "type", *numbers, "digest", "sha1", "bytes")
    whole = _placed(_pieces(spark, path)).drop("n").join(_small(spots), ["path", "split", "in_split"]) \
        .groupBy("path", "start", "rh", "rl").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x")) \
        .select("path", F.col("start").alias("at"), F.expr(
            "substring(cast(array_join(x.value, '" + MAGIC.replace("\r", "\\r").replace("\n", "\\n") + "') AS binary), cast(rh + 5 AS int), cast(rl AS int))").alias("body"))
    whole = whole.select("path", "at", *[c.alias(n) for c, n in zip(_payload(F.col("body")), ("b2", "s2"))])
    return records.join(whole, ["path", "at"], "left").select(
        "path", "at", "type", *numbers, "digest", F.coalesce("sha1", "s2").alias("sha1"), F.coalesce("bytes", "b2").alias("bytes"))


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: the size and digest of
    a revisit's payload are those read from the response it refers to."""
    full = records.where("type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("r"), F.col("sha1").alias("full_sha1"), F.col("bytes").alias("full_bytes")).distinct()
    back = records.where("type = 'revisit'").join(
        full, (F.col("refers_to") == F.col("r")) & (F.col("digest") == F.col("full_sha1")), "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_sha1").alias("payload_digest"), "type", "refers_to")
    return records.where("type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "type",
        F.lit(None).cast("bigint").alias("refers_to")).unionByName(back).withColumnRenamed("type", "record_type") \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(stored(read_archives(spark, path), "warc-records"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k"""
