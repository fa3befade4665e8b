"""Classifiers against plain versions on dense arrays, and joins beyond their broadcast bounds."""

import math
import random

import numpy as np
import pytest

from netlens.llm import mixing, pu_quality, suffix_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
D = pu_quality.N_FEATURES


def cloud(seed, n=600, apart=2.0, trusted=0.5):
    """Two classes of points in the model's features, some of class 1 trusted."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.6
    x = rng.normal(size=(n, D))
    x[:, :4] += apart * (y - 0.6)[:, None]
    x[:, -1] = 1
    return x, y & (rng.random(n) < trusted)


def as_rows(spark, x, positive):
    return spark.createDataFrame([(bool(p), [float(v) for v in r]) for p, r in zip(positive, x)], "positive boolean, f array<double>") \
        .repartition(3).cache()


def plain_risk(x, positive, prior, w):
    """The risk by its definition, on standardised features."""
    mean, std = x.mean(0), x.std(0)
    mean[-1], std[std < 1e-9] = 0.0, 1.0
    t = (x - mean) / std @ w
    loss = lambda z: np.log1p(np.exp(-z))
    p = t[positive]
    return (prior * loss(p).mean() + max(0.0, loss(-t).mean() - prior * loss(-p).mean())
            + pu_quality.RIDGE / 2 * w @ w)


def scale_of(x):
    mean, std = x.mean(0), x.std(0)
    mean[-1], std[std < 1e-9] = 0.0, 1.0
    return mean, std


@pytest.mark.parametrize("prior", [0.01, 0.55, 0.9, 1.0])
def test_weights_minimise_the_risk(spark, prior):
    """No direction leads down from the fitted weights: the risk is convex, so they are its
    minimum; with the high priors the negative part would be below 0 without its bound."""
    x, positive = cloud(3)
    w = pu_quality.fit(as_rows(spark, x, positive), prior, scale_of(x), len(x), positive.sum())
    least = plain_risk(x, positive, prior, w)
    rng = np.random.default_rng(1)
    ways = [*np.eye(D), *rng.normal(size=(300, D)), w, -w]
    for size in (1e-3, 1e-2, 0.1, 1.0):
        for way in ways:
            way = way / max(1e-12, np.linalg.norm(way))
            for sign in (1, -1):
                assert plain_risk(x, positive, prior, w + sign * size * way) >= least - 2e-5
    # subgradient descent from elsewhere does not get below either
    z, at, best = (x - scale_of(x)[0]) / scale_of(x)[1], rng.normal(size=D), np.inf
    for k in range(4000):
        t = z @ at
        s, p = 1 / (1 + np.exp(-t)), positive
        negative = np.log1p(np.exp(t)).mean() - prior * np.log1p(np.exp(t[p])).mean()
        g = prior * ((s[p] - 1)[:, None] * z[p]).mean(0) + pu_quality.RIDGE * at
        if negative > 0:
            g = g + (s[:, None] * z).mean(0) - prior * (s[p][:, None] * z[p]).mean(0)
        at = at - 0.5 / math.sqrt(1 + k / 20) * g
        best = min(best, plain_risk(x, positive, prior, at))
    assert best >= least - 2e-5


def test_search_that_does_not_settle_is_an_error(spark, monkeypatch):
    x, positive = cloud(5, n=80)
    monkeypatch.setattr(pu_quality, "MAX_STEPS", 2)
    with pytest.raises(RuntimeError, match="settle"):
        pu_quality.fit(as_rows(spark, x, positive), 0.5, scale_of(x), len(x), positive.sum())


@pytest.mark.parametrize("share", [0.006, 0.5, 1.0])
def test_prior_by_every_threshold(spark, share):
    """The least ratio of tails, over thresholds of the histogram; small and full shares too."""
    rng = np.random.default_rng(8)
    n = 5000
    y = rng.random(n) < share
    x = np.zeros((n, D))
    x[:, 0] = rng.normal(size=n) + 4 * y
    x[:, -1] = 1
    positive = y & (rng.random(n) < 0.9)
    w = np.zeros(D)
    w[0] = 1.5
    mean, std = scale_of(x)
    got = pu_quality.estimate_prior(as_rows(spark, x, positive), w, (mean, std), n, positive.sum())
    score = 1 / (1 + np.exp(-((x - mean) / std @ w)))
    ratios = []
    for k in range(pu_quality._BINS):
        above = score >= k / pu_quality._BINS
        u, p = above.sum(), (above & positive).sum()
        if p >= pu_quality._LEAST_TAIL * positive.sum():
            ratios.append(u / n / (p / positive.sum()) * (1 + math.sqrt(1 / max(1, p) + 1 / max(1, u))))
    assert abs(got - min(1.0, min(ratios))) < 2e-3
    assert got <= 1.0 and (share > 0.01 or got < 0.02)  # no least prior of its own


def plain_terms(texts, examples, halves):
    """Terms that pass the test, by counting in plain sets."""
    pick = [(y, set(t for w in toxicity.words_of(texts[i] or "") for t in toxicity.terms_of(w))) for i, y, h in examples if h in halves]
    n1, n0 = sum(y for y, _ in pick), sum(1 - y for y, _ in pick)
    if not n1 or not n0:
        return set()
    a, b = {}, {}
    for y, terms in pick:
        for t in terms:
            side = a if y else b
            side[t] = side.get(t, 0) + 1
    can = [t for t in a if a[t] >= toxicity.LEAST_TEXTS and a[t] * n0 > b.get(t, 0) * n1]
    out, rate = set(), n1 / (n1 + n0)
    for t in can:
        x, z = a[t], b.get(t, 0)
        g = 2 * (x * math.log(x / ((x + z) * rate)) + (z * math.log(z / ((x + z) * (1 - rate))) if z else 0))
        if g >= 2 * math.log(len(can) / toxicity.FALSE_TERMS):
            out.add(t)
    return out


def toxic_table(spark, documents, n=400):
    rnd = random.Random(11)
    calm, bad = [f"calm{chr(97 + k)}word" for k in range(26)], [f"nasty{chr(97 + k)}term" for k in range(12)]
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        words = rnd.choices(calm, k=rnd.randint(3, 30)) + rnd.choices(bad, k=rnd.randint(1, 5) if y and rnd.random() < 0.9 else int(rnd.random() < 0.05))
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return documents(rows + [(n, None), (n + 1, ""), (n, None)]), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows)


def test_terms_votes_and_calibration(spark, documents):
    docs, labels, texts = toxic_table(spark, documents)
    examples = toxicity.choose_examples(labels)
    listed = [(r.doc_id, r.toxic, r.half) for r in examples.collect()]
    uses = {r.term: r.uses for r in toxicity.choose_terms(docs, examples).collect()}
    want = [plain_terms(texts, listed, halves) for halves in ((0, 1), (0,), (1,))]
    assert uses == {t: sum(1 << k for k in range(3) if t in want[k]) for t in set().union(*want)}

    # votes: cosines with every example, no index
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    names = sorted(uses)
    texts = texts | {400: "", 401: ""}
    counts = {i: {} for i in texts}
    for i, t in texts.items():
        for w in toxicity.words_of(t):
            for x in toxicity.terms_of(w):
                if x in uses:
                    counts[i][x] = counts[i].get(x, 0) + 1
    rows = [*texts, 400]  # the null row is there twice
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in counts[i] for i in rows))) + 1 for t in names}

    def unit(i, bit):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in counts[i].items() if uses[t] >> bit & 1}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    base = sum(y for _, y, _ in listed) / len(listed)

    def vote(i, bit):
        me = unit(i, bit)
        others = [(j, y, unit(j, bit)) for j, y, _ in listed if j != i]
        near = sorted((-round(sum(x * v.get(t, 0) for t, x in me.items()), 9), j, y) for j, y, v in others if any(t in v for t in me))[:toxicity.K]
        if near:
            yes, all_ = sum(-c * y for c, _, y in near), sum(-c for c, _, _ in near)
        else:
            empty = [y for _, y, v in others if not v]
            yes, all_ = sum(empty), len(empty)
        return min(max((yes + base) / (all_ + 1), 1e-9), 1 - 1e-9), [j for _, j, _ in near]

    votes = [min(max(vote(i, 2 - h)[0], 1e-6), 1 - 1e-6) for i, _, h in sorted(listed)]
    y = np.array([y for _, y, _ in sorted(listed)], float)
    x = np.log(np.array(votes) / (1 - np.array(votes)))

    def cost(a, b):
        z = a * x + b
        return (np.logaddexp(0, z) - y * z).sum() + (a - 1) ** 2 / 2 + 0.005 * b * b
    a, b, size = 1.0, 0.0, 0.5
    while size > 1e-9:  # the curve by descent along the axes
        there = min(((cost(a + p, b + q), a + p, b + q) for p, q in ((size, 0), (-size, 0), (0, size), (0, -size), (size, size), (-size, -size),
                                                                    (size, -size), (-size, size))))
        if there[0] < cost(a, b) and there[1] >= 0:
            _, a, b = there
        else:
            size /= 2
    for i in texts:
        v, near = vote(i, 0)
        assert abs(got[i].score - 1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b)))) < 1e-4
        if len(near) == toxicity.K or near:
            assert {e.doc_id for e in got[i].evidence} == set(near)


def test_terms_joined_equal_terms_broadcast(spark, documents, clash, monkeypatch):
    docs, _, _ = toxic_table(spark, documents, 60)
    for table in (docs, clash, documents([])):
        terms = ["nastyaterm", "nast*", "word", "calmb*", "calmbword", "x"]
        rows = [sorted(map(str, toxicity.term_counts(table, terms).collect()))]
        monkeypatch.setattr(toxicity, "BROADCAST_TERMS", 0)
        rows.append(sorted(map(str, toxicity.term_counts(table, terms).collect())))
        monkeypatch.undo()
        assert rows[0] == rows[1]


def test_joins_beyond_the_broadcast_bounds(spark, monkeypatch):
    """Operators 5, 6 and 9 give the same rows where their sides are shuffled."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def results():
        return [sorted(map(str, df.collect())) for df in (
            warc.op5_warc(spark, SF), mixing.copies(mixing.document_sizes(docs)).select("id", "size", "target", "copies"),
            suffix_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs, hot=2))]

    small = results()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", -1)
    assert results() == small


def test_toxicity_of_bytes_that_are_not_text(spark, documents):
    docs, labels, _ = toxic_table(spark, documents, 60)
    broken = docs.union(docs.limit(1).selectExpr("70L", "CAST(unhex('FF61626364FE') AS STRING)", "lang", "source", "n_chars"))
    rows = {r.doc_id: r for r in toxicity.classify(broken, labels).collect()}
    assert 0 <= rows[70].score <= 1 and set(rows) == {*range(62), 70}
