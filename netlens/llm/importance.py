"""Target-distribution importance resampling (operator 13).

Documents are drawn by how much more likely their features are under a target collection than
under the corpus. Features are all runs of 1 to ``max_n`` words, hashed to ``buckets`` buckets by
CRC-32; counts of both collections give every bucket an integer gain, and a document's weight is
the sum of its features' gains. Adding a Gumbel number drawn from the document's id and keeping
the highest scores draws without replacement in proportion to exp(weight).

1. One pass over the texts leaves each document's bucket numbers (16 or 32 bits a feature).
2. Bucket counts: each task adds up an array and emits its buckets, which are summed.
3. Array-scored weights: the gains are an array of ``buckets`` numbers (the bound of what is sent
   to tasks); a document's weight is the sum of the places its numbers name.
4. Quantile-sketch bracketing: an approximate quantile sketch of the scores gives a bracket around
   the cutoff; exact counts above and inside it validate the bracket, or widen it, and only the
   rows in it are sorted to locate the cutoff. Rows above it are drawn whatever their order, rows
   below it are not.
5. Ranks: drawn rows are dealt to ranges of the order, numbered in tasks, and prefix sums of the
   ranges' counts added (``ranks``); the rows of the bracket follow those above it.

Defined results: null and empty texts have no features and weight 0; a null id draws as the empty
string; ties in the score go to the smaller doc_id (null ids last), then to fewer features; of
equal rows across the cutoff any, as many as fit; extra columns are ignored; an empty table gives
no rows; an empty target counts 0 everywhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .ranks import ranked
from .sql import CRC_TABLE, LOWER, crc32

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lower-cased
MAX_N = 1
BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024
SCALE = 1000          # gains and draws are whole thousandths
SKETCH_ACCURACY = 10_000
_CACHED = 1 << 20     # words whose bucket a worker keeps
_OUT_BYTES = 4 << 20


class _Buckets(dict):
    """Feature bytes -> bucket, filled on demand."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.buckets
        if len(self) >= _CACHED:
            self.clear()
        if len(feature) <= 64:
            self[feature] = at
        return at


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featurize(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and features (binary: the buckets, little-endian unsigned) of
    every row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, of, dtype = re.compile(WORD), _Buckets(buckets), bucket_type(buckets)

        def out(rows) -> pa.RecordBatch:
            ids, words, features = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array([len(f) for f in features], pa.int64()),
                 pa.array([f.tobytes() for f in features], pa.binary())],
                names=["doc_id", "n_words", "n_features", "features"])

        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_buffer()
                words = word.findall(text.to_pybytes().lower()) if text is not None else []
                parts = [np.fromiter(map(of.__getitem__, words), dtype, len(words))]
                for n in range(2, max_n + 1):
                    runs = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
                    parts.append(np.fromiter(map(of.__getitem__, runs), dtype, len(runs)))
                rows.append((doc_id, len(words), np.concatenate(parts)))
                size += rows[-1][2].nbytes
                if size >= _OUT_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")) \
        .mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, features binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of the collection in each bucket that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), bucket_type(buckets)), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket bigint, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 * ln of the smoothed target share over the corpus share), from two
    tables of ``bucket_counts`` (``buckets`` rows at most, summed up on the driver)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, n in ((corpus, s), (target, t)):
        for r in counts.collect():
            n[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((tb + 1.0) * all_s / ((sb + 1.0) * all_t)))
                     for sb, tb in zip(s.tolist(), t.tolist())], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel number) drawn from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -SCALE).cast("bigint")


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: ``gain`` (one number a bucket) added up over each row's
    features."""
    buckets = len(gain)
    sent = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [int(sent.value[np.frombuffer(x.as_buffer(), bucket_type(buckets))].sum()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(w, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "features") \
        .mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = SKETCH_ACCURACY) -> tuple[int | None, int | None, int]:
    """(low, high, above) for the ``k``-th highest of ``n`` scores: it lies in [low, high] (None:
    open), and ``above`` rows have more than high. A sketch of the scores proposes the bracket, two
    exact counts test it; where they show that the k-th is outside, the bracket grows."""
    slack = 2.0 / accuracy
    at = 1 - k / n
    while True:
        ends = [max(0.0, at - slack), min(1.0, at + slack)]
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        low, high = (low if ends[0] > 0 else None), (high if ends[1] < 1 else None)
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, inside = scores.agg(F.count_if(over), F.count_if(~over & ~under)).first()
        if above < k <= above + inside:
            return low, high, above
        slack *= 8


def draw(scores: DataFrame, k: int, n: int, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """``scores`` (doc_id, n_features, weight, score) of the ``n`` documents to draw from, with
    rank: 1 to ``k`` for the highest scores, null for the rest."""
    none = F.lit(None).cast("bigint")
    if k <= 0:
        return scores.withColumn("rank", none)
    low, high, above = bracket(scores, k, n, accuracy)
    over = F.lit(False) if high is None else F.col("score") > high
    under = F.lit(False) if low is None else F.col("score") < low
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"]
    first = ranked(scores.where(over), [], order, "importance-above").withColumn("rank", F.col("rank") + 1)
    inner = ranked(scores.where(~over & ~under), [], order, "importance-bracket") \
        .withColumn("rank", F.col("rank") + 1 + above)
    inner = inner.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return first.unionByName(inner).unionByName(scores.where(under).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, max_n: int = MAX_N,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document of ``docs``
    (doc_id, text); floor(percent * N / 100) of the N with ``min_words`` words are drawn.
    ``target`` holds texts of the distribution to match."""
    own = stored(featurize(docs, max_n, buckets), "importance-features")
    other = featurize(target.select(F.lit(0).alias("doc_id"), "text"), max_n, buckets)
    gain = gains(bucket_counts(own, buckets), bucket_counts(other, buckets), buckets)
    scored = stored(weighed(own, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)),
                    "importance-scores")
    enough = F.col("n_words") >= min_words
    cols = ["doc_id", "n_features", "weight", "score"]
    n = scored.where(enough).count()
    drawn = draw(scored.where(enough).select(cols), percent * n // 100, n)
    return drawn.unionByName(scored.where(~enough).select(*cols, F.lit(None).cast("bigint").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH {CRC_TABLE},
found AS (
  SELECT doc_id, NULL AS item, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, 1, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
bucket_of AS (SELECT word, {crc32("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM found), crc_table),
per AS (SELECT bucket, count(*) FILTER (item IS NULL) AS s, count(*) FILTER (item = 1) AS t
  FROM found JOIN bucket_of USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) + {BUCKETS}::DOUBLE AS all_s, coalesce(sum(t), 0) + {BUCKETS}::DOUBLE AS all_t FROM per),
gains AS (SELECT bucket, floor({SCALE} * ln((t + 1)::DOUBLE * all_s / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain FROM per, sums),
weights AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight
  FROM found JOIN bucket_of USING (word) JOIN gains USING (bucket) WHERE item IS NULL GROUP BY doc_id),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {DRAWN_PERCENT} * n // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)"""
