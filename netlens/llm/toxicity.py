"""Toxicity by nearest labelled examples (operator 10).

Texts become TF-IDF vectors over terms that carry the label, each scored text is compared by
exact cosine with labelled examples in a block-max inverted index, and the nearest ones vote
with their similarity; a logistic calibration, fitted on leave-one-out votes, turns votes into
probabilities. The neighbours are returned as evidence.

The calibration's votes are cross-fitted: examples are dealt into two halves by a hash of their id,
and a half votes over the terms that the labels of the other half chose, so that no label has
a say in the terms that it calibrates.

* Examples: training-fold labels, at most ``MAX_EXAMPLES`` per class, the ones with the
  smallest hash of their id (documented bound; each class is weighted back to its share).
* Terms: words of the examples, and their first ``PREFIXES`` letters, whose association with
  label 1 passes a likelihood-ratio test corrected for the number of candidates. All that pass
  are used. The list comes from the bounded sample; up to ``BROADCAST_TERMS`` it is broadcast to
  the counting tasks, beyond that the texts' terms are joined with it by a shuffle.
* Document frequencies of these terms are counted over all documents.
* Index: per term, its examples in blocks of ``BLOCK`` with the largest weight of each block.
  For a text, the blocks' bounds (sum of its weights times block maxima) are visited in
  falling order until no bound exceeds the k-th best cosine, so the k nearest are exact.

A text without any of the terms has no direction; its neighbours are the examples without
terms, all equally near, and its vote is their share of label 1.

Defined results: a null text counts as empty, bytes that are not UTF-8 as U+FFFD; a null doc_id belongs to the fold of the empty
text; labels for unknown ids or null labels are ignored, and an id labelled twice is toxic if
one label is 1; an example never votes on itself; equal cosines rank by id; with only one
class among the examples the score is its smoothed share; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, identity, stored, table

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
MAX_EXAMPLES = 4096   # of each class
BROADCAST_TERMS = 1_000_000
PREFIXES = (4, 5, 6, 7)  # a word's first letters, so that inflected forms share a term
LEAST_TEXTS = 3       # toxic examples that hold a term
FALSE_TERMS = 0.1     # terms expected to pass the test by chance
CACHE_WORDS = 300_000
K = 15                # neighbours
SMOOTHING = 1.0       # votes of the class shares
BLOCK = 64
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def choose_examples(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0/1), share, half (0/1): the sample of training labels, what a row stands for
    and its half in the calibration."""
    per = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                       & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)) \
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")) \
        .withColumn("draw", F.xxhash64("doc_id"))
    classes = []
    for y in (1, 0):
        of = per.where(F.col("toxic") == y)
        n = of.count()
        classes.append(of.orderBy("draw", "doc_id").limit(MAX_EXAMPLES).select(
            "doc_id", "toxic", F.lit(max(1.0, n / MAX_EXAMPLES)).alias("share"),
            F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")))
    return cut(classes[0].unionByName(classes[1]))


def choose_terms(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """term, uses: words whose presence in an example depends on its label; bit 0 of ``uses`` by
    all examples, bits 1 and 2 by those of half 0 and half 1 alone."""
    texts = docs.join(F.broadcast(examples), "doc_id").select("toxic", "half", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for y, h, t in zip(b.column("toxic").to_pylist(), b.column("half").to_pylist(), b.column("text")):
                n.update((x, 2 * h + y) for x in {x for w in set(words_of(_text(t))) for x in terms_of(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()),
                 pa.array(list(n.values()), pa.int64())], names=["term", "group", "n"])

    per = {(r.half, r.toxic): r["count"] for r in examples.groupBy("half", "toxic").count().collect()}
    held = lambda h, y: F.sum(F.when(F.col("group") == 2 * h + y, F.col("n")).otherwise(0)).cast("double")
    c = cut(texts.mapInArrow(run, "term string, group int, n bigint").groupBy("term").agg(
        held(0, 0).alias("b0"), held(0, 1).alias("a0"), held(1, 0).alias("b1"), held(1, 1).alias("a1")))
    uses = F.lit(0)
    for bit, halves in enumerate(((0, 1), (0,), (1,))):
        n1, n0 = (sum(per.get((h, y), 0) for h in halves) for y in (1, 0))
        if n1 and n0:
            a, b = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0.0)) for x in "ab")
            can, rate = (a >= LEAST_TEXTS) & (a * n0 > b * n1), n1 / (n1 + n0)
            # log-likelihood of the term's label counts against the labels' own shares
            part = lambda x, p, both: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
            least = 2 * np.log(max(1, c.where(can).count()) / FALSE_TERMS)
            gain = 2 * (part(a, rate, a + b) + part(b, 1 - rate, a + b))
            uses = uses + F.when(can & (gain >= least), 1 << bit).otherwise(0)
    return cut(c.select("term", uses.alias("uses")).where("uses > 0"))


def _text(value: pa.Scalar) -> str:
    """A text of a batch; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return value.cast(pa.binary()).as_py().decode("utf-8", "replace") if value.is_valid else ""


_COUNTS = "doc_id bigint, held_out boolean, terms array<int>, counts array<int>"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, held_out, terms, counts of the chosen terms in every document."""
    if len(terms) > BROADCAST_TERMS:
        return _term_counts_joined(docs, terms)
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, known = number.value.get, {}
        for b in batches:
            ids, counts = [], []
            for t in b.column("text"):
                n: Counter = Counter()
                for w in words_of(_text(t)):
                    at = known.get(w)
                    if at is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        at = known[w] = [i for i in map(get, terms_of(w)) if i is not None]
                    if at:
                        n.update(at)
                at = sorted(n)
                ids.append(at)
                counts.append([n[i] for i in at])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "terms", "counts"])

    return _documents(docs).mapInArrow(run, _COUNTS)


def _term_counts_joined(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``term_counts`` with the list as a table: a document's terms go to the shuffle, those that are
    in the list come back to it by the hashes of the row (equal rows have equal counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, k, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text")):
                n = Counter(x for w in words_of(_text(t)) for x in terms_of(w))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(n), pa.int64()), pa.array([k] * len(n), pa.int64()), pa.array(list(n), pa.string()),
                     pa.array(list(n.values()), pa.int32())], names=["a", "b", "term", "n"])

    d = _documents(docs).select("doc_id", "held_out", "text", *identity("doc_id", "text"))
    listed = docs.sparkSession.createDataFrame(list(enumerate(terms)), "number int, term string")
    found = d.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint, term string, n int").join(listed.hint("shuffle_merge"), "term") \
        .groupBy("a", "b", "number").agg(F.max("n").alias("n")) \
        .groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("found"))
    none = F.array().cast("array<int>")
    return d.select("doc_id", "held_out", "a", "b").join(found, ["a", "b"], "left").select(
        "doc_id", "held_out", F.coalesce(F.col("found.number"), none).alias("terms"), F.coalesce(F.col("found.n"), none).alias("counts"))


class BlockMaxIndex:
    """Exact nearest examples by cosine over sparse vectors."""

    def __init__(self, ids, labels, shares, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray,
                 used: np.ndarray | None = None):
        """``used``: which terms count (all of them if None)."""
        self.idf = idf
        self.used = np.ones(len(idf), bool) if used is None else used
        unit = [self.unit(t, c) for t, c in vectors]
        # similar examples go to the same blocks: by their heaviest terms
        order = sorted(range(len(ids)), key=lambda i: (tuple(unit[i][0][np.argsort(-unit[i][1], kind="stable")]), ids[i]))
        order = [i for i in order if len(unit[i][0])]
        empty = [i for i in range(len(ids)) if not len(unit[i][0])]
        pick = lambda x, at, kind: np.array([x[i] for i in at], kind)
        self.ids, self.labels, self.shares = pick(ids, order, np.int64), pick(labels, order, float), pick(shares, order, float)
        self.empty_weight = float(sum(shares[i] for i in empty))
        self.empty_toxic = float(sum(shares[i] * labels[i] for i in empty))
        self.empty = {ids[i]: (shares[i], labels[i]) for i in empty}
        total = float(sum(shares))
        self.base = float(sum(s * y for s, y in zip(shares, labels)) / total) if total else 0.5
        self.n_blocks = -(-len(order) // BLOCK)
        # postings (term, example, weight) by term, then example
        sizes = [len(unit[i][0]) for i in order]
        example = np.repeat(np.arange(len(order)), sizes).astype(np.int64)
        term = np.concatenate([unit[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([unit[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by], weight[by]
        # entries: the postings of one term in one block, and the largest weight of them
        block = self.example // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.posting = np.r_[first, len(term)]
        self.block = block[first]
        self.maximum = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(term[first], np.arange(len(idf) + 1))

    def unit(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = np.asarray(terms, np.int64), np.asarray(counts, float)
        pick = self.used[terms]
        terms, counts = terms[pick], counts[pick]
        w = (1 + np.log(np.maximum(1, counts))) * self.idf[terms]
        return terms, w / max(1e-12, float(np.sqrt((w * w).sum())))

    def nearest(self, terms, counts, k: int = K, without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, example number) of the k nearest, by falling cosine, then id."""
        t, q = self.unit(terms, counts)
        if not len(t) or not len(self.ids):
            return []
        n = self.entry[t + 1] - self.entry[t]
        mine, of = np.arange(n.sum()) + np.repeat(self.entry[t] - (np.cumsum(n) - n), n), np.repeat(q, n)
        by = np.argsort(self.block[mine], kind="stable")
        mine, of = mine[by], of[by]
        bound = np.bincount(self.block[mine], of * self.maximum[mine], minlength=self.n_blocks)
        ends = np.searchsorted(self.block[mine], np.arange(self.n_blocks + 1))
        found: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) == k and bound[b] + 1e-9 < -found[-1][0]):
                break
            dots = np.zeros(BLOCK)
            for x, qi in zip(mine[ends[b]:ends[b + 1]], of[ends[b]:ends[b + 1]]):
                s, e = self.posting[x], self.posting[x + 1]
                dots[self.example[s:e] - b * BLOCK] += qi * self.weight[s:e]
            for o in np.flatnonzero(dots > 0):
                at = int(b) * BLOCK + int(o)
                if self.ids[at] != without:
                    found.append((-round(float(dots[o]), 9), int(self.ids[at]), at))
            found.sort()
            del found[k:]
        return [(-c, at) for c, _, at in found]

    def vote(self, terms, counts, without: int | None = None) -> tuple[float, list[tuple[float, int]]]:
        """Share of label 1 among the neighbours, weighted by cosine and what each example
        stands for, smoothed by the share among all examples; and the neighbours."""
        near = self.nearest(terms, counts, without=without)
        if near:
            w = np.array([c * self.shares[at] for c, at in near])
            yes, all_ = float((w * np.array([self.labels[at] for _, at in near])).sum()), float(w.sum())
        else:
            share, y = self.empty.get(without, (0.0, 0))
            yes, all_ = self.empty_toxic - share * y, self.empty_weight - share
        return (yes + SMOOTHING * self.base) / (all_ + SMOOTHING), near


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the votes' log-odds (ridge on the slope,
    which never falls below zero)."""
    x = np.log(votes / (1 - votes))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 0.5 * (1 + np.tanh((a * x + b) / 2))
        r, h = weights * (p - labels), weights * p * (1 - p)
        g = np.array([(r * x).sum() + (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


_SCORED = ("doc_id bigint, held_out boolean, score double, "
           "evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")


def _score(vectors: DataFrame, index, curve) -> DataFrame:
    """Scores of all vectors; equal vectors of a batch are looked up once."""
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, (a, b) = index.value, curve
        own = {int(i) for i in ix.ids} | set(ix.empty)
        for batch in batches:
            known: dict = {}
            scores, near = [], []
            for doc_id, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "counts"))):
                me = doc_id if doc_id in own else None
                key = (tuple(terms), tuple(counts), me)
                if key not in known:
                    v, found = ix.vote(terms, counts, without=me)
                    v = min(max(v, 1e-9), 1 - 1e-9)
                    z = a * np.log(v / (1 - v)) + b
                    known[key] = (float(0.5 * (1 + np.tanh(z / 2))), [
                        {"doc_id": int(ix.ids[at]), "cosine": c, "toxic": int(ix.labels[at])} for c, at in found])
                s, e = known[key]
                scores.append(s)
                near.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                                              pa.array(near, evidence)], names=["doc_id", "held_out", "score", "evidence"])

    return vectors.select("doc_id", "held_out", "terms", "counts").mapInArrow(run, _SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document. ``labels`` has doc_id
    and toxic."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    examples = choose_examples(labels)
    chosen = choose_terms(docs, examples).orderBy("term").collect()  # from the bounded sample's texts
    uses = np.array([r.uses for r in chosen], np.int64)
    # texts differ much in length: the vectors are dealt out anew, so that scoring tasks are even
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = stored(term_counts(docs, [r.term for r in chosen]).repartition(tasks), "toxicity-vectors")
    n_docs = vectors.count()
    df = np.zeros(len(chosen))
    for t, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = n
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    asked = cut(vectors.join(F.broadcast(examples), "doc_id").dropDuplicates(["doc_id"]))
    rows = asked.orderBy("doc_id").collect()  # at most MAX_EXAMPLES per class

    def index(bit: int):
        return spark.sparkContext.broadcast(BlockMaxIndex(
            [r.doc_id for r in rows], [r.toxic for r in rows], [r.share for r in rows], [(r.terms, r.counts) for r in rows], idf,
            (uses >> bit & 1).astype(bool)))

    curve = (1.0, 0.0)
    if 0 < sum(r.toxic for r in rows) < len(rows):
        votes = {}
        for half in (0, 1):  # over the terms of the other half
            of = asked.where(F.col("half") == half).repartition(tasks)
            votes |= {r.doc_id: r.score for r in _score(of, index(2 - half), curve).select("doc_id", "score").collect()}
        curve = calibration(np.clip([votes[r.doc_id] for r in rows], 1e-6, 1 - 1e-6), np.array([r.toxic for r in rows], float),
                            np.array([r.share for r in rows]))
    return _score(vectors, index(0), curve).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
