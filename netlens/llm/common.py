"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.session import checkpoint_dir

# The white space of the word rule: \x20 and \x09-\x0D; everything else is word text.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """array<string> of the words of ``text`` (null and blank text: empty array)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, WHITE_RUN, -1))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back: its
    lineage is cut, and a lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder (for small iterative tables)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` with its columns behind a generator. A filter on a computed column is otherwise
    pushed below the projections that compute it, and their expressions are repeated inside it,
    each use of a column once more."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def identity(*columns: str) -> list[Column]:
    """Two 64-bit hashes, ``a`` and ``b``, that name a row by its ``columns``. A hash of columns
    passes nulls over, so a mask of the null columns is hashed with them."""
    nulls = F.lit(0)
    for k, c in enumerate(columns):
        nulls = nulls + F.when(F.col(c).isNull(), 1 << k).otherwise(0)
    return [F.xxhash64(F.lit(k), nulls, *columns).alias(name) for k, name in enumerate("ab")]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
