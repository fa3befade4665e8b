"""Removal of repeated byte strings with sharded suffix arrays (operator 9).

A byte is removed if it lies in a ``LENGTH``-byte string that also starts earlier: in a
document with a smaller id, or earlier in the same one. Matches never cross documents.

1. Exact copies of a text other than its first are removed whole (a string of a copy starts
   earlier in the first one), so only first copies go on.
2. Sharding. Every ``LENGTH``-byte string has an anchor: the leftmost least hash among its
   ``GRAM``-byte grams. Equal strings have equal anchors at equal places, so strings can only
   meet under an anchor that occurs twice or more. Anchors are counted by packed numbers;
   within a task's batch equal ones are combined first.
3. For every occurrence of a repeated anchor, the region of the strings that have it there goes
   to the anchor's shard. Within a batch, and again in the shard, equal regions are combined:
   the first one goes on, the others are repeats of it.
4. A shard's different regions are joined and sorted as suffixes by induced sorting; permuted common
   prefixes of ``LENGTH`` or more tie suffixes to groups; all but the earliest member of a
   group start a removed string.
5. Anchors with more than ``HOT`` occurrences would make one shard too large. Their strings go
   as digests instead, spread by digest, and the earliest of each digest stays. Equal digests
   of a batch are combined first, so a hot string costs one row per batch.
6. Removed spans meet their texts; documents without a span keep the digest of their text.

All texts are read whole. Defined results: a null text is empty; a null doc_id counts as
larger than every number; of rows with one id, order is by a hash of the text; of rows equal
in id and text one is the first and the others are copies; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 100
GRAM = 32
BROADCAST_KEYS = 500_000
HOT = 20_000              # occurrences of an anchor that one shard takes
SHARD_BYTES = 1 << 20     # regions sorted at once, in whole shards
_BATCH_BYTES = 16 << 20   # texts handled at once
_NO_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of every ``gram``-byte gram (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = (factor * factor * int(_ODD) | 1) & 0xFFFFFFFFFFFFFFFF
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash of each anchor of ``data``, and the first and last start of the ``length``-byte
    strings that have it: the leftmost least gram moves to the right from string to string, so
    these are runs, and each string is in one of them."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data, gram)
    w = length - gram + 1            # grams of a string
    least, width = np.arange(len(h)), 1  # leftmost least gram of ``width`` grams, by doubling
    while 2 * width <= w:
        a, b = least[:-width], least[width:]
        least = np.where(h[b] < h[a], b, a)
        width *= 2
    rest = w - width
    if rest:
        a, b = least[:-rest], least[rest:]
        least = np.where(h[b] < h[a], b, a)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return h[least[first]], first, np.r_[first[1:], len(least)] - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: place of a row in the order of documents; t: its text."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("t"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about ``_BATCH_BYTES`` of column t."""
    for b in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column("t").cast(pa.binary())], np.int64)
        part, k = np.cumsum(sizes) // _BATCH_BYTES, 0
        while k < b.num_rows:
            end = int(np.searchsorted(part, part[k], side="right"))
            yield b.slice(k, end - k)
            k = end


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() for x in b.column("t").cast(pa.binary())]


# -- anchors that occur twice or more ---------------------------------------------------------

_COUNTED = "bucket int, hash array<bigint>, doc array<int>, n array<bigint>, k1 array<bigint>, k2 array<bigint>"


def _count_batches(buckets: int):
    """Packed anchor counts of a batch, one row per bucket of hashes: hash, number, and the
    document of those that the batch holds once (-1: several, whose documents follow in a row
    of their own, bucket below 0, as already known to be repeated)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
            hs, docs, ns = [], [], []
            for i, text in enumerate(_texts(b)):
                h, _, _ = anchors(np.frombuffer(text, np.uint8))
                u, n = np.unique(h, return_counts=True)
                hs.append(u)
                ns.append(n)
                docs.append(np.full(len(u), i, np.int32))
            if not hs:
                continue
            h, doc, n = np.concatenate(hs), np.concatenate(docs), np.concatenate(ns).astype(np.int64)
            order = np.argsort(h, kind="stable")
            h, doc, n = h[order], doc[order], n[order]
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            total = np.add.reduceat(n, first)
            known = np.repeat(total > 1, np.diff(np.r_[first, len(h)]))
            one_h, one_n = h[first], total
            one_doc = np.where(total > 1, -1, doc[first]).astype(np.int32)
            bucket = (one_h >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, one_h, one_n, one_doc = bucket[order], one_h[order], one_n[order], one_doc[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for s, e in zip(at, np.r_[at[1:], len(bucket)]):
                used, local = np.unique(one_doc[s:e], return_inverse=True)
                off = 1 if used[0] < 0 else 0
                rows.append((int(bucket[s]), one_h[s:e].view(np.int64), (local - off).astype(np.int32), one_n[s:e],
                             k1[used[off:]], k2[used[off:]]))
            if known.any():
                used, local = np.unique(doc[known], return_inverse=True)
                salt = -1 - int(xxhash.xxh32_intdigest(h[:1].tobytes()) % (4 * buckets))
                rows.append((salt, h[known].view(np.int64), local.astype(np.int32), np.zeros(0, np.int64), k1[used], k2[used]))
            yield _lists(rows, ("bucket", "hash", "doc", "n", "k1", "k2"))
    return run


def _lists(rows: list[tuple], names) -> pa.RecordBatch:
    """First column of numbers, the others of arrays."""
    cols = [pa.array([r[0] for r in rows], pa.int32())]
    for k in range(1, len(names)):
        parts = [r[k] for r in rows]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts))))
    return pa.RecordBatch.from_arrays(cols, names=list(names))


def _repeated_in_buckets(limit: int):
    """Rows (k1, k2, hash) of repeated anchors, and (null, null, hash) of those with more than
    ``limit`` occurrences; rows of a bucket come one after another."""
    def out(k1, k2, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([k1, k2, pa.array(h)], names=["k1", "k2", "hash"])

    def close(held) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[2] for x in held])
        doc = np.concatenate([x[1] for x in held])
        base = np.concatenate(([0], np.cumsum([len(x[3]) for x in held])))[:-1]
        of = np.where(doc < 0, -1, doc + np.repeat(base, [len(x[0]) for x in held]))
        k1, k2 = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
        u, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, weights=n).astype(np.int64)
        want = (total[inverse] > 1) & (of >= 0)
        if want.any():
            yield out(pa.array(k1[of[want]]), pa.array(k2[of[want]]), h[want])
        hot = u[total > limit]
        if len(hot):
            yield out(pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int64()), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for k in range(b.num_rows):
                bucket = b.column("bucket")[k].as_py()
                row = [b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("hash", "doc", "n", "k1", "k2")]
                if bucket < 0:
                    yield out(pa.array(row[3][row[1]]), pa.array(row[4][row[1]]), row[0])
                    continue
                if bucket != at and held:
                    yield from close(held)
                    held = []
                at = bucket
                held.append(row)
        if held:
            yield from close(held)

    return run


def repeated_anchors(firsts: DataFrame, hot: int = HOT) -> DataFrame:
    """k1, k2, hash: anchors that occur twice or more, in the documents that hold them; rows
    without keys name the hot ones."""
    tasks = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = firsts.select("k1", "k2", "t").mapInArrow(_count_batches(8 * tasks), _COUNTED)
    return counted.repartition(tasks, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_repeated_in_buckets(hot), "k1 bigint, k2 bigint, hash bigint")


# -- regions of repeated anchors --------------------------------------------------------------

_SENT = "kind int, key bigint, k1 bigint, k2 bigint, start bigint, body binary"
REGION, DIGEST, SPAN = 0, 1, 2


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions, digests of strings under hot anchors, and spans already known to repeat."""
    for b in _batches(batches):
        best: dict = {}   # (kind, key, body) -> earliest (k1, k2, start)
        spans: list[tuple] = []
        for text, k1, k2, want, hot in zip(_texts(b), *(b.column(c).to_pylist() for c in ("k1", "k2")), b.column("hashes"), b.column("hot")):
            h, lo, hi = anchors(np.frombuffer(text, np.uint8))
            h = h.view(np.int64)
            pick = np.isin(h, want.values.to_numpy(zero_copy_only=False))
            h, lo, hi = h[pick], lo[pick], hi[pick]
            is_hot = np.isin(h, hot.values.to_numpy(zero_copy_only=False))
            for x, s, e, digest in zip(h.tolist(), lo.tolist(), hi.tolist(), is_hot.tolist()):
                if digest:
                    items = [(DIGEST, None, hashlib.blake2b(text[i:i + LENGTH], digest_size=16).digest(), i)
                             for i in range(s, e + 1)]
                else:
                    items = [(REGION, x, text[s:e + LENGTH], s)]
                for kind, key, body, i in items:
                    me, other = (k1, k2, i), best.get((kind, key, body))
                    if other is None or me < other:
                        best[kind, key, body] = me
                    if other is not None and other != me:
                        late = max(me, other)
                        spans.append((*late, LENGTH if kind == DIGEST else len(body)))
        rows = [(kind, int.from_bytes(body[:8], "little", signed=True) if key is None else key, *me, body)
                for (kind, key, body), me in best.items()]
        # the spans of a document in the batch, joined
        rows += [(SPAN, k2, k1, k2, s, (e - s).to_bytes(8, "little")) for k1, k2, s, e in _joined(spans)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["kind", "key", "k1", "k2", "start", "body"])


def _joined(spans: list[tuple]) -> list[tuple]:
    """(k1, k2, start, length) -> (k1, k2, start, end) with overlaps joined."""
    out: list[list] = []
    for k1, k2, s, n in sorted(spans):
        if out and out[-1][0] == k1 and out[-1][1] == k2 and s <= out[-1][3]:
            out[-1][3] = max(out[-1][3], s + n)
        else:
            out.append([k1, k2, s, s + n])
    return [tuple(x) for x in out]


def shard_repeats(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, body: list[bytes]) -> list[tuple]:
    """(k1, k2, start, length) of strings of the regions that start earlier in another."""
    lens = np.array([len(x) for x in body])
    ends = np.cumsum(lens + 1)
    # bytes stand for 2.., a separator for 1, the end for 0
    t = np.ones(int(ends[-1]) + 1, np.int32)
    t[-1] = 0
    flat = np.frombuffer(b"".join(body), np.uint8)
    of = np.repeat(np.arange(len(body)), lens)
    place = np.arange(len(flat)) + of
    t[place] = flat.astype(np.int32) + 2
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)[sa]
    region = np.searchsorted(ends, sa, side="right")
    region = np.minimum(region, len(body) - 1)
    whole = sa + LENGTH <= (ends - 1)[region]  # the string ends before the separator
    whole[0] = False
    group = np.cumsum(lcp < LENGTH)
    keep = np.flatnonzero(whole)
    group, region, pos = group[keep], region[keep], sa[keep].astype(np.int64)
    a, b, c = k1[region], k2[region], start[region] + pos - (ends - 1 - lens)[region]
    order = np.lexsort((c, b, a, group))
    group, a, b, c = group[order], a[order], b[order], c[order]
    head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
    later = (a != a[lead]) | (b != b[lead]) | (c != c[lead])
    return [(x, y, z, LENGTH) for x, y, z in zip(a[later].tolist(), b[later].tolist(), c[later].tolist())]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (k1, k2, start, end) from rows sorted by (kind, key, body)."""
    def out(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = _joined(spans)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["k1", "k2", "start", "end"])

    shard: list[tuple] = []   # regions to sort: of anchors with two or more different ones
    group: list[tuple] = []   # different regions of the current anchor
    size, digest, first = 0, None, None

    def close() -> Iterator[pa.RecordBatch]:
        k1, k2, start = (np.array([r[k] for r in shard], np.int64) for k in (1, 2, 3))
        yield from out(shard_repeats(k1, k2, start, [r[4] for r in shard]))

    for b in batches:
        spans: list[tuple] = []
        for kind, key, k1, k2, start, body in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "k1", "k2", "start", "body"))):
            if kind == SPAN:
                spans.append((k1, k2, start, int.from_bytes(body, "little")))
            elif kind == DIGEST:  # sorted by digest, then place: the first one stays
                if body != digest:
                    digest, first = body, (k1, k2, start)
                elif (k1, k2, start) != first:
                    spans.append((k1, k2, start, LENGTH))
            elif group and group[-1][0] == key and group[-1][4] == body:
                if group[-1][1:4] != (k1, k2, start):  # equal regions: the earliest comes first
                    spans.append((k1, k2, start, len(body)))
            else:
                if group and group[0][0] != key:
                    if len(group) > 1:
                        shard += group
                        size += sum(len(r[4]) for r in group)
                    group = []
                    if size >= SHARD_BYTES:
                        yield from close()
                        shard, size = [], 0
                group.append((key, k1, k2, start, body))
        yield from out(spans)
    if len(group) > 1:
        shard += group
    if shard:
        yield from close()


# -- the operator -----------------------------------------------------------------------------

def _small(df: DataFrame) -> DataFrame:
    """Broadcast in joins if its counted keys are few; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def repeated_spans(docs: DataFrame, rows: DataFrame, hot_limit: int = HOT) -> DataFrame:
    """k1, k2, spans (array of start, end, joined by the caller) of first copies. ``rows`` is
    the table of ``describe``."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = cut(rows.where("NOT first").select("k1", "k2").distinct())
    texts = _keyed(docs).where(F.octet_length("t") >= LENGTH).select("k1", "k2", "t")
    firsts = texts.join(_small(copies), ["k1", "k2"], "left_anti")
    found = stored(repeated_anchors(firsts, hot_limit), "anchors")
    hot = cut(found.where("k1 IS NULL").select(F.col("hash").alias("hot")).distinct())
    wanted = found.where("k1 IS NOT NULL").join(_small(hot), F.col("hash") == F.col("hot"), "left") \
        .groupBy("k1", "k2").agg(F.collect_set("hash").alias("hashes"), F.collect_set("hot").alias("hot"))
    holders = cut(found.where("k1 IS NOT NULL").select("k1", "k2").distinct())
    some = texts.join(_small(holders), ["k1", "k2"], "left_semi")
    sent = some.join(wanted, ["k1", "k2"]).select("k1", "k2", "t", "hashes", "hot").mapInArrow(_send, _SENT)
    spans = sent.repartition(tasks, "kind", "key").sortWithinPartitions("kind", "key", "body", "k1", "k2", "start") \
        .mapInArrow(_sort_shards, "k1 bigint, k2 bigint, start bigint, end bigint")
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_bytes, sha (of the whole text), first: whether no earlier row has the
    text. Rows equal in id and text are all first here (see remove_repeats)."""
    d = _keyed(docs)
    rows = stored(d.select("doc_id", "k1", "k2", F.octet_length("t").cast("bigint").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("sha")), "texts")
    least = rows.groupBy("sha").agg(F.min("k1").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "least")
    return rows.join(_small(cut(least)), "sha", "left").select(
        "doc_id", "k1", "k2", "n_bytes", "sha", (F.col("least").isNull() | (F.col("k1") == F.col("least"))).alias("first"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, runs, sha, left = [], [], [], []
        for text, spans in zip(_texts(b), b.column("spans").to_pylist()):
            at, total, n, kept = 0, 0, 0, []
            for x in spans:
                if n and x["start"] <= at:      # touches or overlaps the run before
                    total += max(0, x["end"] - at)
                else:
                    kept.append(text[at:x["start"]])
                    total += x["end"] - x["start"]
                    n += 1
                at = max(at, x["end"])
            kept.append(text[at:])
            whole = b"".join(kept)
            removed.append(total)
            runs.append(n)
            sha.append(hashlib.sha256(whole).hexdigest())
            left.append(whole)
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(sha, pa.string())], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    rows = stored(describe(docs), "texts-first")
    spans = cut(repeated_spans(docs, rows, hot))
    texts = _keyed(docs).select("k1", "k2", "t").join(_small(cut(spans.select("k1", "k2"))), ["k1", "k2"], "left_semi")
    done = texts.dropDuplicates(["k1", "k2"]).join(spans, ["k1", "k2"]).select("k1", "k2", "t", "spans").mapInArrow(
        _cut_out, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    d = rows.join(done, ["k1", "k2"], "left").withColumn("copy", ~F.col("first") | (nth > 1))
    long = F.col("n_bytes") >= LENGTH
    gone = F.col("copy") & long
    zero = F.lit(0).cast("bigint")
    return d.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM n WHERE n_bytes >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, g, min(i) AS s, max(i) + 100 AS e FROM (
    SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_,
    row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS back FROM runs),
kept AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s) || max(CASE WHEN back = 1 THEN substr(h, 2 * e + 1) END) AS h
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)"""
