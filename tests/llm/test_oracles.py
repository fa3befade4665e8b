"""Queries with a DuckDB statement give the statement's rows; all queries keep their columns."""

import duckdb
import pytest

from netlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_pu_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_chunk_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_sentencepiece": ["doc_id", "n_tokens", "ids"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_statement(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    source = "pages" if name == "op5_warc" else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
