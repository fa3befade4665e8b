"""Quality classifier by positive-unlabelled learning (operator 2).

A linear model on text statistics is fitted by minimising the non-negative unbiased risk
    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) + ridge
with logistic loss, from trusted positives (training-fold rows labelled 1), unlabelled texts
(all training-fold rows, their labels unseen) and a class prior pi that is estimated too: for
any threshold t, U(score > t) >= pi * P(score > t), so the least ratio over thresholds bounds
pi from above and meets it where no negative scores that high. Labels 0 are never used. The
prior has no bounds of its own: the positives are among the unlabelled rows, so the ratio is
above 0, and it is at most 1 as a share.

The risk is the larger of two convex functions, the unbiased risk and pi * R_p(+) alone. Its
minimum is that of a blend pi * R_p(+) + share * (R_u(-) - pi * R_p(-)): of share 1 where the
negative part stays at or above 0 there, else of the share at which it is 0, found by false
position. The least value of a blend is concave in its share and its slope is the negative part, so
a blend that falls below the least value of a smaller share is given up: the share sought is
smaller (such a blend may fall almost without end). Every blend is minimised by Newton steps that
may not raise it; steps that do not settle within ``MAX_STEPS`` are an error.

One pass over the texts writes a small feature table; every Newton step is one aggregate over
it (partial sums per task, summed by position), so the driver only sees vectors of the model's
own size. All rows take part; nothing is sampled.

Defined results: a null or empty text has the features of no words and gets a score like any
other; a null doc_id belongs to the fold of the empty text; labels for unknown ids or null
labels are ignored and an id labelled twice counts as positive if one label is 1; without any
positive row the score is 0.5 everywhere; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
RIDGE = 1e-3
MAX_STEPS = 100   # of one search; more are an error
SETTLED = 1e-5    # largest change of a weight in the last step
ZERO_RISK = 1e-5  # negative part that counts as 0
_BINS = 2000      # of the score histogram that the prior is read from
_LEAST_TAIL = 0.2  # share of positives above a threshold that is considered

_CLASS = np.zeros(256, np.int64)  # byte -> class
for _k, _set in enumerate((b"#*$%&<>@^~={}[]\\_+`", b"|", b"!?", b".,;:", b"0123456789",
                           bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b"\n", b"\"'()-/"), 1):
    for _b in _set:
        _CLASS[_b] = _k
_N_CLASSES = 11


def features(text: bytes) -> np.ndarray:
    """Statistics of one text; shares lie in [0, 1], the others are logarithms."""
    words = text.split()
    n, size = len(words), len(text)
    share = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), _N_CLASSES) / max(1, size)
    letters = share[6] + share[7] + share[8]
    if n:
        counts = Counter(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        seen, top = len(counts), max(counts.values())
        runs = sum(map(eq, words, words[1:])) / n
        mean, spread, long = lens.mean(), lens.std(), (lens > 20).mean()
    else:
        seen = top = runs = mean = spread = long = 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines) / max(1, len(lines))
    return np.array([
        np.log1p(n), np.log1p(size), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        np.sqrt(share[1]), np.sqrt(share[2]), np.sqrt(share[3]), np.sqrt(share[4]), np.sqrt(share[5]),
        np.sqrt(share[10]), share[6] / max(1e-9, letters), letters, share[8],
        seen / max(1, n), np.log1p(seen) / np.log(2 + n), top / max(1, n), np.sqrt(runs),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(mean), np.log1p(spread), long, ended,
        float(n < 10), 1.0], np.float64)


N_FEATURES = len(features(b""))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, f (array<double>, the last one constant) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            flat = pa.array(np.concatenate(f) if f else np.zeros(0))
            arr = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * N_FEATURES), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), arr], names=["doc_id", "held_out", "f"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id bigint, held_out boolean, f array<double>")


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of part(positive, X) -> vector, by one aggregate. ``rows`` has
    positive (boolean) and f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
                total += part(b.column("positive").to_numpy(zero_copy_only=False).astype(bool), x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for k, v in rows.select("positive", "f").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _moments(positive: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x), positive.sum()], x.sum(0), (x * x).sum(0), x[positive].sum(0)))


class Risk:
    """The parts of the risk over ``rows``, by one aggregate for each point asked for."""

    def __init__(self, rows: DataFrame, prior: float, scale: tuple[np.ndarray, np.ndarray], n_u: float, n_p: float):
        self.rows, self.prior, self.scale, self.n_u, self.n_p = rows, prior, scale, n_u, n_p

    def at(self, w: np.ndarray):
        """(value, gradient, Hessian) of pi * R_p(+) with the ridge, and of R_u(-) - pi * R_p(-)."""
        mean, std = self.scale
        d = N_FEATURES

        def part(positive, x):
            z = (x - mean) / std
            t = z @ w
            s, loss = _sigmoid(t), np.logaddexp(0, t)
            h = s * (1 - s)
            p = z[positive]
            return np.concatenate(([loss.sum(), loss[positive].sum()], z.T @ s, p.T @ s[positive], p.sum(0),
                                   ((z * h[:, None]).T @ z).ravel(), ((p * h[positive][:, None]).T @ p).ravel()))

        v = _summed(self.rows, part, 2 + 3 * d + 2 * d * d)
        risk_u, risk_p = v[0] / self.n_u, v[1] / self.n_p
        grad_u, grad_p, mean_p = v[2:2 + d] / self.n_u, v[2 + d:2 + 2 * d] / self.n_p, v[2 + 2 * d:2 + 3 * d] / self.n_p
        hess_u = v[2 + 3 * d:2 + 3 * d + d * d].reshape(d, d) / self.n_u
        hess_p = v[2 + 3 * d + d * d:].reshape(d, d) / self.n_p
        pi = self.prior
        # logistic loss: l(t) - l(-t) = -t
        keep = (pi * (risk_p - mean_p @ w) + RIDGE / 2 * w @ w, pi * (grad_p - mean_p) + RIDGE * w, pi * hess_p + RIDGE * np.eye(d))
        return keep, (risk_u - pi * risk_p, grad_u - pi * grad_p, hess_u - pi * hess_p)

    def least(self, share: float, w: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, float | None, float]:
        """Minimum of the blend, from ``w``, the negative part there (None if the blend was given
        up below ``floor``) and its value."""
        step, best = np.zeros(len(w)), np.inf
        for _ in range(MAX_STEPS):
            keep, negative = self.at(w + step)
            value, slope, hess = (a + share * b for a, b in zip(keep, negative))
            if value < floor:
                return w + step, None, float(value)
            if value > best + 1e-12:
                step = step / 2
                continue
            length = np.abs(step).max()
            if best < np.inf and length < SETTLED:
                return w + step, float(negative[0]), float(value)
            w, best = w + step, value
            step = -np.linalg.solve(hess, slope)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        raise RuntimeError(f"the risk of share {share} did not settle in {MAX_STEPS} steps")


def fit(rows: DataFrame, prior: float, scale: tuple[np.ndarray, np.ndarray], n_u: float, n_p: float,
        start: np.ndarray | None = None) -> np.ndarray:
    """Weights (on standardised features) that minimise the non-negative risk."""
    risk = Risk(rows, prior, scale, n_u, n_p)
    left, low, floor = risk.least(0.0, np.zeros(N_FEATURES) if start is None else start)
    if low <= ZERO_RISK:
        return left
    w, high, _ = risk.least(1.0, left if start is None else start, floor)
    if high is not None and high >= -ZERO_RISK:
        return w
    # the negative part falls as its share grows; false position, with halving of a side kept
    # twice, and the middle where the blend of the larger share was given up
    a, b, side = 0.0, 1.0, 0
    for _ in range(MAX_STEPS):
        share = (a + b) / 2 if high is None else (a * high - b * low) / (high - low)
        w, now, value = risk.least(share, left, floor)
        if now is not None and abs(now) <= ZERO_RISK:
            return w
        if now is not None and now > 0:
            a, low, left, floor = share, now, w, value
            high = high / 2 if side > 0 and high is not None else high
            side = 1
        else:
            b, high = share, now
            low = low / 2 if side < 0 else low
            side = -1
    raise RuntimeError(f"the share of the negative part did not settle in {MAX_STEPS} steps")


def estimate_prior(rows: DataFrame, w: np.ndarray, scale, n_u: float, n_p: float) -> float:
    """Least ratio of unlabelled to positive rows above a threshold of the score."""
    mean, std = scale

    def part(positive, x):
        at = np.minimum((_sigmoid(((x - mean) / std) @ w) * _BINS).astype(int), _BINS - 1)
        return np.concatenate((np.bincount(at, minlength=_BINS), np.bincount(at[positive], minlength=_BINS)))

    v = _summed(rows, part, 2 * _BINS)
    above_u, above_p = np.cumsum(v[:_BINS][::-1]) / n_u, np.cumsum(v[_BINS:][::-1]) / n_p
    wide = above_p >= _LEAST_TAIL
    # one standard error on top, so that noise in a small tail does not pass for a low prior
    noise = np.sqrt(1 / np.maximum(1, above_p * n_p) + 1 / np.maximum(1, above_u * n_u))
    return float(min(1.0, np.min((above_u / np.maximum(above_p, 1e-12) * (1 + noise))[wide])))


def train(table_: DataFrame, positives: DataFrame):
    """Weights and scale from ``table_`` (feature_table) and ``positives`` (doc_id of trusted
    positives); None where there is no positive."""
    mark = positives.select("doc_id").distinct().withColumn("p", F.lit(True))
    rows = stored(table_.where("NOT held_out").join(mark, "doc_id", "left").select(
        F.coalesce("p", F.lit(False)).alias("positive"), "f"), "pu-rows")
    m = _summed(rows, _moments, 2 + 3 * N_FEATURES)
    n_u, n_p = m[0], m[1]
    if not n_p:
        return None
    mean = m[2:2 + N_FEATURES] / n_u
    std = np.sqrt(np.maximum(m[2 + N_FEATURES:2 + 2 * N_FEATURES] / n_u - mean ** 2, 0))
    mean[-1], std[std < 1e-9] = 0.0, 1.0
    scale = (mean, std)
    first = fit(rows, 0.5, scale, n_u, n_p)
    prior = estimate_prior(rows, first, scale, n_u, n_p)
    return fit(rows, prior, scale, n_u, n_p, first), scale, prior


def scored(table_: DataFrame, model) -> DataFrame:
    if model is None:
        return table_.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    w, (mean, std), _ = model
    v, shift = w / std, float(-(w * mean / std).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(_sigmoid(x @ v + shift))],
                                             names=["doc_id", "held_out", "score"])

    return table_.mapInArrow(run, "doc_id bigint, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. ``labels`` has doc_id, quality."""
    features_ = stored(feature_table(docs), "pu-features")
    trusted = labels.where((F.col("quality") == 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)) \
        .select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return scored(features_, train(features_, trusted)).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
