"""Operators against plain Python versions."""

import hashlib
import random
import re

import numpy as np
import xxhash

from netlens.llm import chunk_fingerprints as C
from netlens.llm import mixing, simhash, suffix_dedup
from netlens.llm.suffix_array import permuted_lcp, suffix_array

SF = "/root/testdata/sf0.001"


def simhash_classes(docs):
    fps = []
    for _, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            best[find(a)] = min(best.get(find(a), i), i)
    return sorted(((i, f"{fps[a]:016x}", best.get(find(a))) for a, (i, _) in enumerate(docs)), key=str)


def run_simhash(df):
    sigs = simhash.fingerprints(df.select("doc_id", "text"))
    return sorted(((r.doc_id, f"{r.fp % 2 ** 64:016x}", r.component_id) for r in simhash.classes(sigs).collect()), key=str)


def test_simhash_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run_simhash(df) == simhash_classes([(r.doc_id, r.text) for r in df.collect()])


def test_simhash_odd_rows(clash, odd):
    assert run_simhash(clash) == simhash_classes([(r.doc_id, r.text) for r in odd.collect()])


def test_simhash_links_with_hot_keys(spark):
    """Chains of near fingerprints under few keys, dealt to many chunks."""
    rnd = random.Random(5)
    fps, x = set(), rnd.getrandbits(64)
    for _ in range(600):
        x ^= 1 << rnd.randrange(64)
        if rnd.random() < 0.05:
            x ^= rnd.getrandbits(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    from netlens.llm.components import components
    got = {r.node % 2 ** 64: r.root for r in components(simhash.links(df, chunk=16)).collect()}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((find(f), find(g)))
                root[b] = a
    for f in fps:
        for g in fps:
            same = (got.get(f, f) == got.get(g, g)) if f in got and g in got else f == g
            assert same == (find(f) == find(g))


def test_counters_agree_with_popcount():
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2)
    lanes[::3] = lanes[0] ^ (np.uint64(1) << rng.integers(0, 64, len(lanes[::3]), dtype=np.uint64))
    planes, valid = simhash._planes(lanes), np.full(4, 2 ** 64 - 1, np.uint64)
    q, word = np.repeat(lanes[:20], 4), np.tile(np.arange(4), 20)
    for radius in (0, 1, 3, 4, 7, 20):
        pair, bits = simhash.near_lanes(q, word, planes, valid, radius)
        got = {(int(p), k) for p, b in zip(pair, bits) for k in range(64) if int(b) >> k & 1}
        want = {(p, k) for p in range(80) for k in range(64) if int(q[p] ^ lanes[word[p] * 64 + k]).bit_count() <= radius}
        assert got == want


def removed(docs, length=100):
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    for k in order:
        b = (docs[k][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((docs[k][0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run_removed(df, **kw):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, **kw).collect()), key=str)


def test_repeats_table_and_hot_path(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = removed([(r.doc_id, r.text) for r in df.collect()])
    assert run_removed(df) == want
    assert run_removed(df, hot=2) == want


def test_repeats_odd_rows(documents):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = [(9, "a" * 3000), (2, "xy" * 200), (3, "q" + "xy" * 200), (4, None), (5, ""), (6, passage),
            (7, "head " + passage + " tail"), (8, passage[:99]), (1, "é" + passage[50:200] + "日"), (10, passage), (10, passage)]
    assert run_removed(documents(rows)) == removed(rows)
    assert run_removed(documents(rows), hot=1) == removed(rows)
    assert run_removed(documents([])) == []


def test_repeats_defined_for_nulls_and_clashes(clash):
    rows = run_removed(clash)
    assert len(rows) == 12 and all(0 <= r[2] <= r[1] for r in rows)


def test_suffix_array_small():
    rnd = random.Random(2)
    for _ in range(400):
        n, al = rnd.randint(1, 40), rnd.choice([1, 2, 3, 20])
        t = np.array([rnd.randint(1, al) for _ in range(n)] + [0])
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        p = permuted_lcp(t, sa)
        for r in range(1, n + 1):
            i, j, k = sa[r], sa[r - 1], 0
            while i + k <= n and j + k <= n and t[i + k] == t[j + k]:
                k += 1
            assert p[i] == k


def test_chunk_boundaries_by_definition():
    rnd = random.Random(4)
    for size in (0, 1, 31, 32, 33, 500, 5000):
        data = bytes(rnd.randrange(97, 123) for _ in range(size))
        h = [sum(int(C.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2 ** 32 for i in range(size)]
        at, want = 0, []
        while at < size:
            end = next((e for e in range(at + C.MIN, min(at + C.MAX, size) + 1)
                        if h[e - 1] & int(C.LOOSE if e - at >= C.NORMAL else C.STRICT) == 0
                        or e - at <= C.NORMAL and h[e - 1] & int(C.STRICT) == 0), min(at + C.MAX, size))
            at = end
            want.append(at)
        assert C.boundaries(data) == want


def test_next_document_and_edit(spark, documents):
    for docs in ([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], [(3, "only one text")], []):
        got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_next) for r in C.fingerprints(documents(docs)).collect()}
        order, want = sorted(docs, reverse=True), {}
        for k, (i, x) in enumerate(order):
            y = order[(k + 1) % len(order)][1]
            edit = x[:len(x) - len(x) // 3] + y[:len(x) // 3]
            want[i] = (len(x), hashlib.sha256(edit.encode()).hexdigest(), C.containment(C.chunk_set(x.encode()), C.chunk_set(y.encode())))
        assert got == want


def test_chunks_survive_an_insertion():
    rnd = random.Random(6)
    text = bytes(rnd.randrange(32, 127) for _ in range(20000))
    other = text[:7000] + b"inserted words" + text[7000:]
    assert C.containment(C.chunk_set(text), C.chunk_set(other)) > 0.9
    assert C.containment(C.chunk_set(text), C.chunk_set(text)) == 1.0


def test_short_texts_keep_chunks_when_edited():
    rnd = random.Random(7)
    line = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    for size, least in ((60, 0.8), (100, 0.95), (200, 0.99)):
        near = []
        for _ in range(300):
            text, other = line(size), line(size)
            chunks = C.chunk_set(text.encode())
            near.append(C.containment(chunks, C.chunk_set(C.edited(text, other).encode())))
            assert C.containment(chunks, C.chunk_set(other.encode())) == 0
        assert np.mean([x > 0 for x in near]) >= least


def test_fingerprints_odd_rows(clash):
    rows = C.fingerprints(clash).collect()
    assert len(rows) == 12 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1


def targets(sizes):
    """Water filling by repetition."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [n for n in names if n not in fixed]
        share = {n: rest * weight[n] / sum(weight[f] for f in free) for n in free}
        over = [n for n in free if share[n] > 3 * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: 3.0 * sizes[n] for n in over}


def test_mixing(spark, documents):
    rnd = random.Random(8)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 20, 60, 200])), rnd.choice(["a", "a", "a", "a", "b", "c", None, "tiny"] if k % 50 else ["z"]))
            for k in range(6000)]
    df = documents(rows)
    got = mixing.copies(mixing.document_sizes(df)).collect()
    assert sorted(r.id for r in got) == list(range(6000))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = targets(sizes), {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        rate = want[r.source] / sizes[r.source]
        assert int(rate + 1e-9) <= r.copies <= min(3, int(rate) + 1)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) < 200
    again = mixing.copies(mixing.document_sizes(df.repartition(7))).collect()
    assert {r.id: r.copies for r in again} == {r.id: r.copies for r in got}


def test_mixing_is_unbiased(documents):
    df = mixing.document_sizes(documents([(k, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(60)])).cache()
    times = [{r.id: r.copies for r in mixing.copies(df, seed=s).collect()} for s in range(12)]
    rate = {r.id: r.target / r.source_size for r in mixing.copies(df).collect()}
    mean = sum(t[i] - rate[i] for t in times for i in rate) / (12 * 60)
    assert abs(mean) < 0.05


def test_mixing_odd_rows(clash, documents):
    got = mixing.copies(mixing.document_sizes(clash)).collect()
    assert len(got) == 12
    total = sum(r.copies for r in got)
    assert mixing.mix(clash).count() == total
    assert mixing.copies(mixing.document_sizes(documents([]))).count() == 0 and mixing.mix(documents([])).count() == 0
    assert all(r.copies == 0 for r in mixing.copies(mixing.document_sizes(documents([(1, None), (2, " ")]))).collect())


def test_mixing_balances_large_documents(documents):
    """One document with a fifth of its source's words: the others make up for either draw."""
    rows = [(k, "w " * (20 + k % 40), "a") for k in range(300)] + [(1000, "w " * 3000, "a")] \
        + [(2000 + k, "w " * 30, "b") for k in range(400)]
    df = mixing.document_sizes(documents(rows)).cache()
    drawn = set()
    for seed in range(6):
        got = mixing.copies(df, seed=seed).collect()
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) < 60
        drawn.add(next(r.copies for r in got if r.id == 1000))
    assert len(drawn) == 2  # both outcomes occur
