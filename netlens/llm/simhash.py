"""SimHash near-duplicates with bit-sliced comparison (operator 1).

1. Every whole text gets a 64-bit fingerprint: XXH64 of each word shingle, majority per bit.
2. Distinct fingerprints are keyed by every choice of ``key_blocks`` of ``blocks`` bit blocks.
   With blocks - key_blocks >= radius, two fingerprints within the radius agree on at least
   one choice, so comparing inside equal keys loses no link.
3. Inside a key, fingerprints stand as 64 vertical bit planes: one XOR compares a fingerprint
   with 64 others at a bit, carry-save counters (with a sticky overflow) add up the
   differences of all 64 lanes, and a lane block is abandoned once every lane is over the
   radius. Keys with more than ``CHUNK`` fingerprints are dealt to pairs of chunks, so no
   group of a task exceeds 2 * CHUNK rows however hot the key is.
4. Each comparison task emits a spanning forest of its links, not all pairs; the components
   come from star contraction.

Exact copies share a fingerprint, so only one row per distinct fingerprint is compared.
Defined results: a null text counts as empty, its fingerprint is zero and is linked like any
other; a null doc_id belongs to its component but is never its id unless no id is there
(then null); repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, cut, identity, stored, table
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCKS, KEY_BLOCKS = 6, 2  # 15 keys of 20 to 22 bits
CHUNK = 2048               # fingerprints of a key compared at once
_LANES = 32_768            # 64-lane blocks handled by one numpy step
_HASHES = 65_536           # shingle hashes expanded to bits at once


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes. ``bytes.lower`` and ``bytes.split`` are ASCII
    only: A-Z, and the white space \\x20 \\x09-\\x0D."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _HASHES):
        h = np.fromiter((digest(line[s:e], seed) for s, e in zip(first[k:k + _HASHES], last[k:k + _HASHES])), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` must have the column text; its other columns are kept, and fp is added."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest, F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            cols = [b.column(c) for c in rest] + [pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "fp"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def block_masks(blocks: int = BLOCKS, key_blocks: int = KEY_BLOCKS) -> list[int]:
    """Unsigned masks of all choices of ``key_blocks`` of ``blocks`` nearly equal bit blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, key_blocks)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) -> links (node, smallest node reached), the same components."""
    if not len(a):
        return a, b
    nodes, idx = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = idx[:len(a)], idx[len(a):], np.arange(len(nodes))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], m)
        np.minimum.at(new, label[y], m)
        new = np.minimum(new[label], new[new])
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _planes(fp: np.ndarray) -> np.ndarray:
    """(64, words) vertical bit planes of lanes; len(fp) is a multiple of 64."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lanes x 64
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _over(count: list[np.ndarray], sticky: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, held in bit planes, is over the radius."""
    more, equal = sticky.copy(), ~sticky
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            more |= equal & count[k]
            equal &= ~count[k]
    return more


def near_lanes(q: np.ndarray, word: np.ndarray, planes: np.ndarray, valid: np.ndarray,
               radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (fingerprint q[i], 64-lane block word[i]): indices of the pairs with a lane
    in the radius, and those lanes as bits."""
    n_bits = max(1, (radius + 1).bit_length())
    live = np.arange(len(q))
    count = [np.zeros(len(q), np.uint64) for _ in range(n_bits)]
    sticky = ~valid[word]
    one = np.uint64(1)
    for b in range(0, 64, 2):
        w = word[live]
        x = planes[b][w] ^ (np.uint64(0) - ((q[live] >> np.uint64(b)) & one))
        y = planes[b + 1][w] ^ (np.uint64(0) - ((q[live] >> np.uint64(b + 1)) & one))
        # full adder of two planes into the lowest counter, then ripple the carry
        half = x ^ y
        carry = (x & y) | (count[0] & half)
        count[0] ^= half
        for k in range(1, n_bits):
            up = count[k] & carry
            count[k] ^= carry
            carry = up
        sticky |= carry
        if b >= 14 and b % 8 == 6:
            keep = _over(count, sticky, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                live, sticky = live[keep], sticky[keep]
                count = [c[keep] for c in count]
                if not len(live):
                    break
    lanes = ~_over(count, sticky, radius)
    hit = lanes != 0
    return live[hit], lanes[hit]


def link_groups(group: np.ndarray, mine: np.ndarray, other: np.ndarray, fp: np.ndarray,
                radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many groups at once. Rows are sorted by ``group``; rows flagged
    ``mine`` are queries, rows flagged ``other`` are compared with them."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    gid = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    n_other = np.add.reduceat(other.astype(np.int64), starts)
    n_words = -(-n_other // 64)
    first = np.concatenate(([0], np.cumsum(n_words)))
    o = np.flatnonzero(other)
    at = first[gid[o]] * 64 + (np.cumsum(other) - 1)[o] - (np.cumsum(n_other) - n_other)[gid[o]]
    lanes = np.zeros(int(first[-1]) * 64, np.uint64)
    lanes[at] = fp[o]
    filled = np.zeros(len(lanes), np.uint8)
    filled[at] = 1
    valid = np.packbits(filled, bitorder="little").view(np.uint64)
    planes = _planes(lanes)
    m = np.flatnonzero(mine)
    reps = n_words[gid[m]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(reps)
    k = 0
    while k < len(m):  # queries whose lane blocks fit one step
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _LANES, side="right")))
        r = reps[k:stop]
        q = np.repeat(fp[m[k:stop]], r)
        word = np.repeat(first[gid[m[k:stop]]], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
        pair, bits = near_lanes(q, word, planes, valid, radius)
        if len(pair):
            hits = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hits)
            a, b = q[pair[i]], lanes[word[pair[i]] * 64 + lane]
            far = a != b
            found.append(spanning(a[far], b[far]))
        k = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return spanning(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _link_partition(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, i, j, c, fp = cols
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            many = size[group] > 1  # a fingerprint alone under its key has no link
            if not many.any():
                return
            group, i, j, c, fp = (x[many] for x in (group, i, j, c, fp))
            a, b = link_groups(group, c == i, c == j, fp.view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "c", "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[cut_at:] for x in cols]  # the last group may go on in the next batch
            if cut_at:
                yield from out([x[:cut_at] for x in cols])
        if held is not None and len(held[0]):
            yield from out(held)

    return run


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, key_blocks: int = KEY_BLOCKS,
          chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp bigint) -> links (u, v) that span the same components as all
    pairs within ``radius``. Exact for any radius up to blocks - key_blocks."""
    if radius > blocks - key_blocks:
        raise ValueError(f"radius {radius} needs blocks - key_blocks >= radius")
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, key_blocks)]
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("bigint").alias("m")) for k, m in enumerate(signed)])
    # the mask's number is mixed in, so that equal bits under different masks do not meet
    keyed = fps.select("fp", F.explode(masks).alias("x")) \
        .select("fp", F.xxhash64("x.k", F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk) \
        .select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    d = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    d = d.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    d = d.select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")) \
        .select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j") \
        .mapInArrow(_link_partition(radius), "u bigint, v bigint")


def classes(sigs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``sigs`` (doc_id, fp, other columns) with component_id, the smallest doc_id that links reach,
    and root, a fingerprint that names the component (where ids repeat, component_id need not)."""
    nodes = sigs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(nodes.select("fp"), radius))
    rooted = cut(nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # apart, so that a large component's rows can be split
    return sigs.join(rooted.join(ids, "root").select("fp", "component_id", "root"), "fp", "left")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (null ids last; of its
    rows with the same id any one, the same on every run). The columns of ``documents``."""
    docs = docs.select(*DOCUMENT_COLUMNS, *identity(*DOCUMENT_COLUMNS))
    sigs = stored(fingerprints(docs.select("doc_id", "text", "a", "b"), shingle), "simhash")
    best = classes(sigs, radius).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b")).alias("x")).select("x.a", "x.b")
    return docs.join(best, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select(DOCUMENT_COLUMNS)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = stored(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    return classes(sigs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
