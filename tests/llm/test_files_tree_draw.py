"""Token files, Merkle manifest and importance resampling against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netlens.llm import importance, merkle, token_files
from netlens.llm.common import scratch_path
from netlens.llm.ranks import ranked

WORDS = ["Alpha", "beta", "gamma's", "delta,", "42", "émigré", "日本語", "<|endoftext|>x", "it's", "é", "̸z", "ω9"]


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def some_texts(n, seed):
    rng = random.Random(seed)
    gaps = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x0b", "\x1c"]
    return ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randrange(40))) for _ in range(n)]


# ranks

def test_ranked(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3, 4])) for _ in range(3000)] + [("hot", 5)] * 2000
    got = ranked(spark.createDataFrame(data, "g string, x bigint"), ["g"], [F.col("x").desc_nulls_last()], "test-ranked").collect()
    per = defaultdict(list)
    for g, x, k in got:
        per[g].append((k, x))
    assert {g: len(v) for g, v in per.items()} == Counter(g for g, _ in data)
    for v in per.values():
        v.sort()
        assert [k for k, _ in v] == list(range(len(v)))
        assert [x for _, x in v] == sorted((x for _, x in v), key=lambda x: -(x or 0))


# token files

def plain_tokens(docs):
    t, out, at = Tokenizer.from_file(token_files.TOKENIZER), [], 0
    for doc_id, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def read(spark, docs, mapped=None):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs, path)
    got = token_files.read_tokens(spark, path, mapped).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c"))
    return path, sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])


def test_tokens_equal_the_library(spark, documents):
    docs = list(enumerate(some_texts(300, 2)))
    path, got = read(spark, documents(docs))
    assert got == plain_tokens(docs)
    assert read(spark, documents(docs), mapped=False)[1] == got
    # the files themselves: flat 16-bit ids, 64-bit offsets
    first = token_files.shards(spark, path).orderBy("shard").first()
    shard = token_files.open_shard(token_files.local_path(first["file"]), "<u2")
    assert isinstance(shard.all, np.memmap) and shard.all.dtype == np.uint16 and shard.ends.dtype == np.uint64
    assert [shard.doc_id(i) for i in range(len(shard))] == [r[0] for r in got[:len(shard)]]
    assert shard.ids(0)[-1] == 2 and len(shard.all) == shard.ends[-1] == first["n_ids"]


def test_words_equal_the_library():
    with open(token_files.TOKENIZER, "rb") as f:
        words = token_files._Words(f.read(), "<u2")
    rng = random.Random(3)
    signs = "aBçÉéeÈo0９٣ı İſḰ̸ªº日本'’sStrevmld.,-<|>endoftext_&\x1c\x00\x7f\u200b\xad\xa0ΩωΣςßẞЖжǅﷺﬁ "
    for _ in range(20000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "'s", "'S.", "é,", "<|endoftext|>"])
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text.encode()) == np.array(ids, "<u2").tobytes(), repr(text)


def test_tokens_odd_rows(spark, odd, clash):
    _, got = read(spark, odd)
    assert [r[0] for r in got] == [None, None, None, 1, 1, 2, 3, 4, 5, 5, 6, 7]
    plain = Counter((k, n, c) for k, _, n, c in plain_tokens([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert Counter((k, n, c) for k, _, n, c in got) == plain
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])
    assert Counter(read(spark, clash)[1]) == Counter(got)
    assert read(spark, odd.where("false"))[1] == []


def test_tokens_hot_id_is_split(spark, documents):
    path, got = read(spark, documents([(7, f"text {i % 3}") for i in range(4000)]))
    assert len(got) == 4000 and token_files.shards(spark, path).count() > 1


def test_tokens_not_utf8(spark, documents):
    docs = documents([(1, "ok")]).withColumn("text", F.expr("cast(unhex('6F6BFF20C3') as string)"))
    assert read(spark, docs)[1] == plain_tokens([(1, "ok� �")])


@pytest.mark.parametrize("end_id", [300, 65535, 65536])
def test_wide_end_ids(spark, documents, end_id):
    path = scratch_path(spark, "test-end")
    token_files.write_tokens(documents([(1, "a b"), (2, "")]), path, end_id=end_id)
    assert token_files.id_type_of(spark, path) == "<u4"
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [int.from_bytes(r["ids"][-4:], "little") for r in got] == [end_id] * 2
    with pytest.raises(ValueError, match="2 [*]{2} 24"):
        token_files.write_tokens(documents([(1, "a")]), scratch_path(spark, "test-end"), end_id=1 << 24)


# Merkle manifest

def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text), leaves without ties."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))

    def climb(nodes):  # digests -> top, steps of each
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                first = k - k % 16
                steps[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + 16])))
            nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
            at = [k // 16 for k in at]
        return nodes[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = {}
    for s, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in own])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper):
        for r, own in zip(by[s], trees[s][1]):
            steps, h = own + up, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                h = leaf(r[:4] + (re.sub("[A-Z]", lambda m: m[0].lower(), r[4]),))
            for a, b in steps:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return out


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (257, 1), (40, 40), (700, 3), (600, 300)])
def test_manifest(spark, n, sources):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "Z", "a", "é"] + [f"s{k}" for k in range(sources)]) if sources > 1 else "s", rng.choice([None, "en"]),
             rng.choice([None, 3]), rng.choice([None, "", f"Text {i} é", "lower"])) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == sorted(plain_manifest(rows))


def test_manifest_odd_rows(spark, odd, clash):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    want = sorted(plain_manifest(rows), key=lambda r: tuple((x is not None, x) for x in r))
    assert rows_of(merkle.manifest(odd)) == want
    assert rows_of(merkle.manifest(clash)) == want
    assert merkle.manifest(odd.where("false")).collect() == []


def test_manifest_tampering_shows(spark):
    rows = [(i, "s", "en", 4, "Text" if i % 2 else "text") for i in range(500)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    changed = {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 2}
    assert changed and {r["doc_id"] for r in got if not r["verified"]} == changed


# importance resampling

def plain_resample(docs, target, percent=10, max_n=1, buckets=10_000, min_words=20, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    own = [(k, *features(x)) for k, x in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    out = []
    for k, n, f in own:
        w = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def resampled(spark, docs, target, **kw):
    return rows_of(importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **kw))


def by_nulls(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("kw", [{}, {"percent": 100}, {"percent": 0}, {"max_n": 2, "buckets": 97}, {"min_words": 0, "percent": 37}])
def test_resample(spark, documents, kw):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Lorem", "ipsum", "dolor", "sit", "amet", "été", "7"]) for _ in range(rng.randrange(60))) for _ in range(800)]
    target = ["ipsum dolor 7", None, "été " * 9]
    docs = list(enumerate(texts))
    assert resampled(spark, documents(docs), target, **kw) == by_nulls(plain_resample(docs, target, **kw))


def test_resample_odd_rows(spark, odd, clash):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = by_nulls(plain_resample(docs, ["word one"], percent=50, min_words=1))
    assert resampled(spark, odd, ["word one"], percent=50, min_words=1) == want
    assert resampled(spark, clash, ["word one"], percent=50, min_words=1) == want
    assert resampled(spark, odd, [], percent=50, min_words=1) == by_nulls(plain_resample(docs, [], percent=50, min_words=1))
    assert resampled(spark, odd.where("false"), ["a"]) == []


@pytest.mark.parametrize("values", [[3] * 500, list(range(500)), [1] * 250 + list(range(250))])
def test_bracket_holds_the_cutoff(spark, values):
    """A sketch of low accuracy proposes brackets that miss; the exact counts widen them."""
    scores = spark.createDataFrame([(i, 1, 0, v) for i, v in enumerate(values)],
                                   "doc_id bigint, n_features bigint, weight bigint, score bigint")
    down = sorted(values, reverse=True)
    for k in (1, 2, 50, 249, 251, 499, 500):
        low, high, above = importance.bracket(scores, k, 500, accuracy=3)
        assert (low is None or low <= down[k - 1]) and (high is None or down[k - 1] <= high)
        assert above == (0 if high is None else sum(v > high for v in values)) < k
    got = importance.draw(scores, 251, 500, accuracy=3).where("rank is not null").orderBy("rank").collect()
    order = sorted(range(500), key=lambda i: (-values[i], i))[:251]
    assert [r["doc_id"] for r in got] == order and [r["rank"] for r in got] == list(range(1, 252))
