"""Token-ID output (operator 11): flat unsigned integer files with 64-bit document offsets.

Layout below a folder, one shard per task:

- ``kind=ids/part-N...``: the ids of the shard's documents one after another, little-endian
  unsigned integers (16 bits where the vocabulary fits and the end id is below 256, else 32), an end id
  after each document;
- ``kind=offsets/part-N...``: for every document a little-endian unsigned 64-bit number, where
  it ends in the shard, in ids (it starts where the one before ends);
- ``kind=names/part-N...``: for every document its doc_id (signed, 64 bits) and 0, or 0 and 1 for
  a null id (64 bits).

``_format`` holds one row: the ids' type and the end id. Shards are ranges of doc_id in ascending
order. Where a shard begins in the whole is the sum of
the lengths before it: a prefix sum over one row per shard, taken from the files' sizes.

Writing: documents are dealt to id ranges and sorted (one shuffle of the texts), encoded in the
task, and written by Spark's text writer: every record ends in a zero byte (of the end id, of an
offset below 2 ** 56, of the 0 / 1 after a doc_id), which the writer puts there as its line
separator. So the files are made with Spark's commit protocol in any file system Spark
knows, and a lost task leaves nothing behind.

Reading: one task per shard maps the files into memory. In a store that has no paths to open,
the contents come through Spark's binary reader (shards must be below 2 GB there).

Encoding is the tokenizers library's. It treats texts between ASCII white space independently
(white space is only a border to its normaliser and its pattern), so words are cached; tests
compare with whole texts. Names of special tokens in a text become their ids, as the library's
``encode`` does it.

Defined results: null and empty texts are a lone end id; rows without doc_id come first; rows
that tie in doc_id are in the order of a hash of their text, equal rows in any order; bytes that
are not UTF-8 are read as U+FFFD; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table
from .ranks import in_order

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
MAX_TOKENIZER_BYTES = 64 << 20
_CACHED_BYTES = 64         # longer words are encoded each time
_CACHED_WORDS = 1 << 20
_OUT_BYTES = 4 << 20


# The normaliser and pre-tokenizer for which a word's pieces are known without them.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# of printable ASCII in lower case the pattern comes to this, and the other steps change nothing
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_BYTES = _MARKS.encode()
_LATIN_TO_CYRILLIC = "\u0500"
# byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = dict(zip([x for x in range(256) if x not in _PRINTED], range(256, 512)))


def _known(settings: dict) -> bool:
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (settings.get("normalizer") or {}).get("normalizers") == _NORMALIZER \
        and split[0].get("pattern") == {"Regex": _PATTERN} and [x["type"] for x in split] == ["Split", "ByteLevel"] \
        and not split[1]["add_prefix_space"]


class _Words(dict):
    """UTF-8 word -> its ids in the file format, filled on demand.

    Where the tokenizer file has the settings above, a printable ASCII word is the pieces of its
    lower case, a word of Latin, Greek or Cyrillic letters is its lower case, and marks after either
    are a piece of their own. Pieces are given to the library's model, and words that differ in case
    or marks share them. All other words are given to the library whole."""

    def __init__(self, data: bytes, dtype: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer, self.code = Tokenizer.from_str(data.decode()), "H" if dtype == "<u2" else "I"
        self.model = self.tokenizer.model if _known(json.loads(data)) else None
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values())
                                  or b"(?!)")

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _whole(self, word: bytes) -> bytes:
        return self._packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _piece(self, piece: bytes) -> bytes:
        """``piece`` as it is after all steps before the model."""
        return self._packed([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))])

    def _pieces(self, word: bytes) -> bytes:
        letters = word.rstrip(_MARK_BYTES)
        if letters.isalpha():  # ASCII letters
            lower = letters.lower()
            if len(letters) < len(word):
                return self[lower] + self[word[len(letters):]]
            return self._piece(word) if lower == word else self[lower]
        if _PRINTABLE.fullmatch(word):
            if self.special.search(word):
                return self._whole(word)
            pieces = _PIECE.findall(word.lower())
            return self._piece(word) if pieces == [word] else b"".join(map(self.__getitem__, pieces))
        text = letters.decode("utf-8", "replace")
        lower = "".join([c.lower() for c in text])
        if text.isalpha() and lower.isalpha() and max(text) < _LATIN_TO_CYRILLIC and unicodedata.is_normalized("NFC", text):
            if len(letters) < len(word):
                return self[letters] + self[word[len(letters):]]
            return self._piece(lower.encode())
        return self._whole(word)

    def __missing__(self, word: bytes) -> bytes:
        out = self._pieces(word) if self.model else self._whole(word)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict = {}  # of this Python worker: the last model used


def encoder(data: bytes, dtype: str) -> _Words:
    key = (hash(data), dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Words(data, dtype)
    return _ENCODERS[key]


def id_type(data: bytes, end_id: int) -> str:
    """Narrowest little-endian unsigned type for all ids of the tokenizer file in which the end id's
    last byte is zero."""
    from tokenizers import Tokenizer
    most = max(Tokenizer.from_str(data.decode()).get_vocab(with_added_tokens=True).values())
    if end_id >> 24:
        raise ValueError(f"the end id {end_id} is not below 2 ** 24")
    return "<u2" if most < 1 << 16 and end_id < 1 << 8 else "<u4"


def _records(model, dtype: str, end_id: int):
    """mapInArrow function: sorted (doc_id, text) -> (kind, n, value) without last bytes."""
    end = np.array([end_id], dtype).tobytes()

    def out(names, ends, values, first) -> Iterator[pa.RecordBatch]:
        n = np.arange(first, first + len(values))
        offsets = np.array(ends, "<u8")
        if len(offsets) and int(offsets[-1]) >> 56:
            raise ValueError("a shard holds 2 ** 56 ids or more")
        known = np.array([(0, 1) if x is None else (x, 0) for x in names], "<i8").reshape(-1, 2)
        for kind, rows in (("ids", values), ("offsets", [x.tobytes()[:-1] for x in offsets]),
                           ("names", [x.tobytes()[:-1] for x in known])):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows)), pa.array(n, pa.int64()), pa.array(rows, pa.binary())],
                names=["kind", "n", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(model.value, dtype)
        width, at, first = len(end), 0, 0
        names, ends, values, size = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_buffer()
                ids = (words.encode(text.to_pybytes()) if text is not None else b"") + end
                at += len(ids) // width
                names.append(doc_id)
                ends.append(at)
                values.append(ids[:-1])
                size += len(ids)
                if size >= _OUT_BYTES:
                    yield from out(names, ends, values, first)
                    first += len(values)
                    names, ends, values, size = [], [], [], 0
        if values:
            yield from out(names, ends, values, first)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs`` (doc_id, text) below ``path``, a shard for each shuffle
    partition that has rows."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_TOKENIZER_BYTES} bytes")
    dtype = id_type(data, end_id)
    model = spark.sparkContext.broadcast(data)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    d = in_order(d, ["doc_id", F.xxhash64("text")])
    records = d.mapInArrow(_records(model, dtype, end_id), "kind string, n bigint, value binary")
    records.sortWithinPartitions("kind", "n").select("kind", F.col("value").cast("string").alias("value")) \
        .write.partitionBy("kind").option("lineSep", "\0").text(path)
    spark.createDataFrame([(dtype, end_id)], "dtype string, end_id bigint").coalesce(1).write.parquet(f"{path}/_format")


def id_type_of(spark: SparkSession, path: str) -> str:
    """The ids' type in the files below ``path``."""
    return spark.read.schema("dtype string, end_id bigint").parquet(f"{path}/_format").first()["dtype"]


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard (number of the task that wrote it), file (of its ids), n_ids and start (ids of all
    shards before it). The listing reads no content."""
    width = np.dtype(id_type_of(spark, path)).itemsize
    s = _files(spark, path, "ids").select("shard", "path", "length")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return s.select("shard", F.col("path").alias("file"), F.expr(f"length div {width}").alias("n_ids")) \
        .withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, length, content and shard of the files of one kind."""
    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary") \
        .format("binaryFile").load(path)
    files = files.where(F.col("kind") == kind) if "kind" in files.columns else files.where(F.lit(False))
    return files.withColumn("shard", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int"))


class Shard:
    """Documents of one shard: ``ids(i)`` and ``names``, from three arrays."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, names: np.ndarray):
        self.all, self.ends, self.names = ids, offsets, names.reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.ends)

    def start(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.all[self.start(i):int(self.ends[i])]

    def doc_id(self, i: int) -> int | None:
        return None if self.names[i, 1] else int(self.names[i, 0])


def local_path(file: str) -> str | None:
    """The path to open of a listed file, or None where it is in a store without paths."""
    return "/" + file.removeprefix("file:").lstrip("/") if file.startswith("file:") else None


def open_shard(file: str, dtype: str) -> Shard:
    """A shard whose files are mapped into memory; ``file`` is the path of its ids."""
    other = lambda kind: file.replace("kind=ids", f"kind={kind}")
    at = lambda f, t: np.memmap(f, t, "r") if os.path.getsize(f) else np.empty(0, t)
    return Shard(at(file, dtype), at(other("offsets"), "<u8"), at(other("names"), "<i8"))


_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _rows(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
    def out(rows) -> pa.RecordBatch:
        doc, start, n, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids"])

    rows, size = [], 0
    for i in range(len(shard)):
        ids = shard.ids(i)
        rows.append((shard.doc_id(i), base + shard.start(i), len(ids), ids.astype("<u4").tobytes()))
        size += len(rows[-1][3]) + 64
        if size >= _OUT_BYTES:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def read_tokens(spark: SparkSession, path: str, mapped: bool | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (the end id included) and ids
    (little-endian unsigned 32-bit) of every document below ``path``. ``mapped``: map the files into
    memory (the default where they have paths to open)."""
    s, dtype = shards(spark, path), id_type_of(spark, path)
    if mapped is None:
        some = s.select("file").first()
        mapped = some is not None and local_path(some["file"]) is not None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if mapped:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield from _rows(open_shard(local_path(file), dtype), base)

        return s.select("file", "start").repartition(tasks).mapInArrow(run, _SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, *parts in zip(*(b.column(i) for i in range(4))):
                arrays = [np.frombuffer(x.as_buffer(), t) for x, t in zip(parts, (dtype, "<u8", "<i8"))]
                yield from _rows(Shard(*arrays), base.as_py())

    whole = s.select("shard", "start")
    for kind in ("ids", "offsets", "names"):
        whole = whole.join(_files(spark, path, kind).select("shard", F.col("content").alias(kind)), "shard")
    return whole.select("start", "ids", "offsets", "names").mapInArrow(read, _SCHEMA)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
