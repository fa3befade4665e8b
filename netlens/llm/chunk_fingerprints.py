"""Document fingerprints by content-defined chunking (operator 7).

A gear hash over the last 32 bytes marks boundaries; chunking is normalised: no boundary
below ``MIN`` bytes, a strict mask up to ``NORMAL``, a loose one up to ``MAX``, where a
boundary is forced. A fingerprint is the set of chunk digests with their lengths, so an
insertion changes only the chunks around it, and the length-weighted share of one set found
in another measures containment of the texts.

``with_next`` pairs every document with the one that follows it in descending doc_id, without
a global sort in one task: documents are dealt to id ranges whose bounds are ids of the table;
the first document of a range is also sent to the range before, where it ends the row stream
(the very first one to the last range). One shuffle of the texts, streamed in sorted order, so
a task holds two documents at a time.

Defined results: a null text counts as empty; an empty text has the empty fingerprint; the
likeness of two empty fingerprints is 1, of an empty and a non-empty one 0; rows with the same
id follow each other in order of text; null ids come last; a table of one row is its own next
document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fine enough for short texts: an edited text of 60 bytes still has an unchanged chunk
MIN, NORMAL, MAX = 8, 24, 512
STRICT = np.uint32(0xF8000000)  # 5 bits: one position in 32
LOOSE = np.uint32(0xE0000000)   # 3 bits: one position in 8
# one 32-bit number per byte value, by rule
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)
_STEP = 1 << 20        # bytes hashed at once
_RANGES_PER_TASK = 4
_OUT_ROWS, _OUT_BYTES = 1000, 8 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k for k below 32, by doubling the window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def _positions(data: bytes) -> tuple[list[int], list[int]]:
    """Byte positions that end a chunk under the strict and the loose mask."""
    raw = np.frombuffer(data, np.uint8)
    strict, loose = [], []
    for k in range(0, len(raw), _STEP):
        lead = min(k, 31)  # the window of the first position reaches back
        h = gear_hashes(raw[k - lead:k + _STEP])[lead:]
        at = np.flatnonzero((h & LOOSE) == 0)
        loose.append(at + k + 1)
        strict.append(at[(h[at] & STRICT) == 0] + k + 1)
    return np.concatenate(strict).tolist(), np.concatenate(loose).tolist()


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n, at, out = len(data), 0, []
    if n > MIN:
        strict, loose = _positions(data)
        while n - at > MIN:
            i = bisect_left(strict, at + MIN)
            end = strict[i] if i < len(strict) else n
            if end > at + NORMAL:
                i = bisect_left(loose, at + NORMAL)
                end = loose[i] if i < len(loose) else n
            at = min(end, at + MAX, n)
            out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest -> length of the distinct chunks of ``data``."""
    digest, at, out = xxhash.xxh64_intdigest, 0, {}
    for end in boundaries(data):
        out[digest(data[at:end])] = end - at
        at = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of ``a``, by length, whose chunks are in ``b``."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def spelled(chunks: dict[int, int]) -> str:
    """The set as text: 16 hex digits and the length of each chunk, in order of digest."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def _range_of(doc_id, bounds: list[int]):
    """Number of ``bounds`` (descending) that are >= doc_id, by bisection; null: all."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    state = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.transform(
            F.array(F.floor((s["lo"] + s["hi"]) / 2).cast("int")),
            lambda m: F.when(F.get(arr, m) >= doc_id, F.struct((m + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))[0]))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(state["lo"])


def in_ranges(docs: DataFrame) -> DataFrame:
    """range, guest, doc_id, text: every partition holds whole id ranges in descending order;
    guest rows are the document that follows the range."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = tasks * _RANGES_PER_TASK
    cuts, most = d.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n), F.max("doc_id")).first()
    bounds = sorted({b for b in cuts or [] if b != most}, reverse=True)
    last = len(bounds)
    own = F.struct(F.col("r").cast("int").alias("range"), F.lit(False).alias("guest"))
    heads = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    before = F.when(F.get(heads, F.col("r") - 1) == F.col("doc_id"),
                    F.array(F.struct((F.col("r") - 1).cast("int").alias("range"), F.lit(True).alias("guest"))))
    wrap = F.when(F.col("doc_id") == F.lit(most).cast("bigint"),
                  F.array(F.struct(F.lit(last).alias("range"), F.lit(True).alias("guest"))))
    none = F.array().cast("array<struct<range:int,guest:boolean>>")
    d = d.withColumn("r", _range_of(F.col("doc_id"), bounds).cast("int"))
    d = d.select("doc_id", "text", F.explode(F.concat(F.array(own), F.coalesce(before, none), F.coalesce(wrap, none))).alias("x"))
    return d.select("x.range", "x.guest", "doc_id", "text").repartition(tasks, "range") \
        .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc, nxt) -> tuple:
    doc_id, text, chunks = doc
    changed = edited(text, nxt[1]).encode()
    new = chunk_set(changed)
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), spelled(chunks), spelled(new),
            containment(chunks, new), containment(chunks, nxt[2]))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each document of the sorted stream with its next one."""
    at = first = held = None
    for b in batches:
        for r, guest, doc_id, text in zip(*(b.column(i) for i in range(4))):
            r, guest, doc_id = r.as_py(), guest.as_py(), doc_id.as_py()
            if r != at:
                if held is not None:  # a range without a guest: the table has no other range
                    yield held, first
                at, first, held = r, None, None
            elif guest and held is None:
                continue  # further rows with the guest's id
            text = text.as_py() or ""
            doc = (doc_id, text, chunk_set(text.encode()))
            if held is not None:
                yield held, doc
            first = first or doc
            held = None if guest else doc
    if held is not None:
        yield held, first


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for doc, nxt in _pairs(batches):
        rows.append(_row(doc, nxt))
        size += len(rows[-1][3]) + len(rows[-1][4])
        if len(rows) >= _OUT_ROWS or size >= _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, with both likenesses."""
    return in_ranges(docs).mapInArrow(_fingerprint_rows, _SCHEMA)


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
