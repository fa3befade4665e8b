"""Rows that differ only in which column is null, and many equal rows."""

import itertools
from collections import Counter

from netlens.llm import mixing, simhash
from netlens.llm.common import DOCUMENT_COLUMNS, identity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_identity_over_all_null_patterns(spark):
    values = [(7, None), ("x", None), ("x", None), ("x", None), (7, None)]
    rows = list(itertools.product(*values))
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select(*identity(*DOCUMENT_COLUMNS)).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == 32
    again = df.union(df).select(*identity(*DOCUMENT_COLUMNS)).distinct()
    assert again.count() == 32


def test_deduplicate_tells_nulls_apart(spark):
    df = spark.createDataFrame([(7, "x", None, "s", 1), (7, None, "x", "s", 1)], SCHEMA)
    ids = simhash.classes(simhash.fingerprints(df.selectExpr("doc_id", "text"))).collect()
    assert len({r.fp for r in ids}) == 2
    # one id in two components: a row for the id, as the docstring says, whichever it is, in each
    df = spark.createDataFrame([(7, "alpha beta gamma delta", None, "s", 1), (7, None, "alpha beta gamma delta", "s", 1),
                                (8, None, None, None, None)], SCHEMA)
    kept = simhash.deduplicate(df).collect()
    assert Counter(map(tuple, kept)) <= Counter(map(tuple, df.collect()))
    assert {r.text for r in kept} == {"alpha beta gamma delta", None}


def test_mix_gives_copies_to_the_right_row(spark):
    rows = [(7, "one two three", None, None, 3), (7, None, None, "one two three", 3)] + \
        [(k, "w " * 30, "en", "other", 60) for k in range(100, 110)]
    df = spark.createDataFrame(rows, SCHEMA)
    copies = {}
    for r in mixing.copies(mixing.document_sizes(df)).collect():
        copies[(r.id, r.size)] = copies.get((r.id, r.size), 0) + r.copies
    got = Counter((r.doc_id, r.text) for r in mixing.mix(df).collect())
    assert got.get((7, "one two three"), 0) == copies[(7, 3)]
    assert got.get((7, None), 0) == copies[(7, 0)] == 0


def test_mix_of_many_equal_rows(spark, documents):
    """A third of all rows are equal; more of them, and of their copies, than a chunk."""
    same = [(1, "a b c", "s")] * 2500
    df = documents(same + [(k, "w " * (k % 9 + 1), "sr"[k % 2]) for k in range(10, 3000)])
    sizes = mixing.document_sizes(df)
    got = mixing.copies(sizes).collect()
    assert len(got) == df.count() and Counter(r.id for r in got)[1] == 2500
    taken = {s: sum(r.copies * r.size for r in got if r.target == s) for s in {r.target for r in got}}
    assert all(abs(taken[t] - t) < 10 for t in taken)
    again = mixing.copies(mixing.document_sizes(df.repartition(5))).collect()
    assert Counter((r.id, r.copies) for r in again) == Counter((r.id, r.copies) for r in got)
    mixed = Counter(r.doc_id for r in mixing.mix(df).select("doc_id").collect())
    per = Counter()
    for r in got:
        per[r.id] += r.copies
    assert mixed == Counter({k: n for k, n in per.items() if n}) and mixed[1] > mixing.CHUNK
