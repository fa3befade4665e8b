"""Fixtures of the corpus operators' tests."""

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """rows of (doc_id, text[, source]) -> DataFrame with the columns of documents."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    return documents([
        (None, None, None), (None, None, None), (None, "", "a"), (1, "", "b"), (1, "", "b"), (2, " \t\n ", "b"),
        (3, "word " * 20000, "a"), (4, "One two three four five, six seven eight nine ten eleven.", None),
        (5, "One two three four five, six seven eight nine ten eleven.", None), (5, "Other text with the same id.", "a"),
        (6, "x" * 50000, "c"), (7, "日本語 " * 300 + "é▁😀\x00", "c")])


@pytest.fixture
def clash(odd):
    """The same rows with extra columns whose names operators might use themselves."""
    out = odd
    for c in ("row", "t", "words", "key", "k", "fp", "size", "p", "range", "at", "spans", "kept", "score", "a", "b", "k1", "k2", "bucket"):
        out = out.selectExpr("*", f"1 AS `{c}`")
    return out
