"""The pipeline against plain versions of its decisions."""

import corpus_pipeline as P
from netlens.llm import mixing, quality_rules, secret_scan
from netlens.llm.common import DOCUMENT_COLUMNS, stored, table
from netlens.llm.sentencepiece_codec import MODEL

from test_brute_force import simhash_classes

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = []
    for name, f in P.STAGES:
        docs = stored(f(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_each_stage_on_its_own_input(spark):
    import sentencepiece
    docs = table(spark, SF, "documents")
    q, n, s, m, t = stages(spark, docs)
    for df in (q, n, s, m):
        assert df.columns == DOCUMENT_COLUMNS
    verdict = {r.doc_id: r for r in quality_rules.measure(docs).select("row.doc_id", "kept", "clean_text").collect()}
    assert {r.doc_id: r.text for r in q.collect()} == {k: v.clean_text for k, v in verdict.items() if v.kept}
    rows = [(r.doc_id, r.text) for r in q.collect()]
    keep = {c for _, _, c in simhash_classes(rows)}
    assert sorted(r.doc_id for r in n.collect()) == sorted(keep)
    before = {r.doc_id: r.text for r in n.collect()}
    assert len(before) == s.count()
    spans = {r.doc_id: r.found for r in secret_scan.scan(n).select("row.doc_id", "found").collect()}
    for r in s.collect():
        assert (r.text != before[r.doc_id]) == bool(spans[r.doc_id]) and r.n_chars == len(r.text)
    copies = {r.id: r.copies for r in mixing.copies(mixing.document_sizes(s)).collect()}
    got = {}
    for r in m.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: c for k, c in copies.items() if c}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in m.collect()}
    for r in t.collect():
        assert r.ids == lib.encode(texts[r.doc_id]) and r.round_trip
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(P.run(spark, SF)) == key(t)


def test_odd_and_empty_tables(spark, odd, documents):
    stages(spark, odd)
    assert [x.count() for x in stages(spark, documents([]))] == [0] * 5
    for name, f in P.STAGES:  # each stage alone takes every kind of row
        assert f(spark, odd, SF).count() >= 1
