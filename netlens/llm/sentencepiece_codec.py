"""SentencePiece encoding and decoding by streaming Viterbi (operator 8).

The vocabulary comes from a public ``.model`` file (its path is a parameter; the bytes are
broadcast, under a size check). Encoding walks the text once. At each boundary it keeps the
surviving last piece and a backpointer; a later piece can only start in the last ``max_len``
boundaries, so once the paths from all of these share a boundary, everything before it is
committed and forgotten.

* Unigram models: the survivor at a boundary is the best sum of piece scores.
* BPE models: a segmentation is what the merges give exactly if each piece is made by its own
  characters' merges and each two neighbours, merged alone, stay apart. So at a boundary
  there is one survivor: the piece that is stable beside the survivor at its start. The ids
  are those of the model's own BPE.

No piece spans two neighbouring characters that stand together in no piece (for one, a space
after a word). All paths meet there, and texts are cut at such spaces up front, which lets a
bounded cache keep the ids of recent words.

Defined results: a null text counts as empty; the empty text has no ids and decodes to ''; the
character U+2581, which the model uses for the space, decodes to a space; characters outside
the vocabulary become byte pieces where the model has them, else the unknown id, which decodes
to U+2047 between spaces as the library writes it; ``decoded`` reads a null id and an id that the
model does not have as the unknown id, and null ids as no ids. Repeated rows are encoded one by one;
extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20  # broadcast bound, checked
SPACE = "▁"
CACHE_WORDS = 500_000       # words whose ids a worker keeps, in each of two generations
CACHE_PAIRS = 1_000_000
CACHE_CHARS = 48            # longer strings are not kept
_OUT_IDS = 4_000_000
_UNKNOWN_PENALTY = 10.0


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        kind, norm = m.trainer_spec.model_type, m.normalizer_spec
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalization are supported")
        self.bpe, self.prefix = kind == 2, norm.add_dummy_prefix
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        raw: list[bytes] = []
        self.unk = 0
        for i, p in enumerate(m.pieces):
            text = b""
            if p.type in (1, 4):    # normal, user defined
                self.pieces[p.piece], self.score[p.piece] = i, p.score
                text = p.piece.replace(SPACE, " ").encode()
            elif p.type == 6:       # byte
                self.byte[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:       # unknown
                self.unk = i
                text = " ⁇ ".encode()
            raw.append(text)
        self.max_len = max(map(len, self.pieces), default=1)
        self.lowest = min(self.score.values(), default=0.0) - _UNKNOWN_PENALTY
        self.together = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        # cut the text at spaces only if no piece has a space after another character
        inner = any(x[1] == SPACE and x[0] != SPACE for x in self.together)
        # ... and around ASCII characters that stand beside no other in a piece
        joined = {c for x in self.together for c in x}
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in joined)
        one = f"|[{alone}]" if alone else ""
        self._words = None if inner else re.compile(f"{SPACE}*[^{SPACE}{alone}]+{one}|{SPACE}+")
        self._flat = np.frombuffer(b"".join(raw), np.uint8)
        self._lens = np.array([len(x) for x in raw], np.int64)
        self._starts = np.concatenate(([0], np.cumsum(self._lens)[:-1]))
        self._names = [p.piece for p in m.pieces]
        self._scores = [p.score for p in m.pieces]
        self._span = len(self._names) + 0x110000
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._stable: dict[int, bool] = {}
        self._trie: dict = {}
        self._split: dict[str, tuple[str, str]] = {}  # BPE: a piece's last merge
        for piece, i in self.pieces.items():
            if self.bpe:
                parts, last = self.merged(piece)
                if len(parts) > 1:
                    continue  # its own characters merge into something else
                if last:
                    self._split[piece] = last
            node = self._trie
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = i

    # -- BPE: what the merges make of a short string, and the test built on it

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols left when no merge is possible, and the last merge."""
        parts, score, last = list(text), self.score, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces stay apart. Their merges are undone, latest first;
        if, before one of them, the symbols at the border could have merged earlier, they
        would have. Of equal merges the left one comes first."""
        x, y = self._text(a), self._text(b)
        score, split = self.score, self._split
        stable = x[-1] + y[0] not in self.together
        if not stable:
            s = score.get(x + y)
            stable = s is None
            while stable and (x in split or y in split):
                if y not in split or (x in split and score[x] < score[y]):
                    limit = score[x]
                    x = split[x][1]
                    s = score.get(x + y)
                    stable = s is None or s <= limit
                else:
                    limit = score[y]
                    y = split[y][0]
                    s = score.get(x + y)
                    stable = s is None or s < limit
        if len(self._stable) >= CACHE_PAIRS:
            self._stable.clear()
        self._stable[a * self._span + b] = stable
        return stable

    def _text(self, i: int) -> str:
        """A lone character outside the vocabulary has the number n + its code point."""
        return self._names[i] if i < len(self._names) else chr(i - len(self._names))

    # -- the streaming pass

    def stream(self, text: str) -> Iterator[int]:
        """Numbers of the pieces of ``text`` (spaces already U+2581), committed as soon as
        they are sure. Pieces that end at a boundary are found by walking back from it in a
        trie of reversed pieces."""
        n, span, bpe, trie = len(self._names), self._span, self.bpe, self._trie
        stable, scores, pieces = self._stable, self._scores, self.pieces
        base = 0                       # committed boundary
        back, last = [0], [-1]         # per boundary: where its survivor starts, and which it is
        best = [0.0]                   # unigram: the score of its path
        look_at = 4 * self.max_len
        for j in range(1, len(text) + 1):
            i, node, top = j - 1, trie, None
            start, which = i, -1
            while i >= base:
                node = node.get(text[i])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    if bpe:
                        before = last[i - base]
                        if before < 0:
                            ok = True
                        else:
                            ok = stable.get(before * span + piece)
                            if ok is None:
                                ok = self._is_stable(before, piece)
                        if ok:
                            start, which = i, piece
                            break
                    else:
                        score = best[i - base] + scores[piece]
                        if top is None or score > top:
                            start, which, top = i, piece, score
                i -= 1
            if which < 0 or (not bpe and start < j - 1 and text[j - 1] not in pieces
                             and best[j - 1 - base] + self.lowest > top):
                start, which = j - 1, pieces.get(text[j - 1], n + ord(text[j - 1]))
                top = best[j - 1 - base] + self.lowest
            back.append(start)
            last.append(which)
            best.append(top or 0.0)
            if j - base < look_at:
                continue
            # later pieces start in the last ``max_len`` boundaries: step the farthest one
            # back until a single boundary is left, where all their paths meet
            front = set(range(max(base, j - self.max_len + 1), j + 1))
            while len(front) > 1:
                far = max(front)
                front.discard(far)
                front.add(back[far - base])
            meet = front.pop()
            if meet > base:
                yield from self._path(back, last, base, meet)
                k = meet - base
                back, last, best, base = back[k:], last[k:], best[k:], meet
                look_at = 4 * self.max_len
            else:
                look_at = 2 * (j - base)  # still apart: look again later
        yield from self._path(back, last, base, len(text))

    @staticmethod
    def _path(back: list[int], last: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = back[end - base]
        out.reverse()
        return out

    def _ids(self, i: int) -> tuple[int, ...]:
        if i < len(self._names):
            return (i,)
        return tuple(self.byte.get(b, self.unk) for b in self._text(i).encode()) if self.byte else (self.unk,)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self._older.get(word)
        if ids is None:
            ids = tuple(self.stream(word))
            if ids and max(ids) >= len(self._names):
                ids = tuple(x for i in ids for x in self._ids(i))
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_WORDS:  # words used since then move on
                self._older, self._cache = self._cache, {}
            self._cache[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; nothing is added before or after."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        out: list[int] = []
        if self._words is None:
            out.extend(self._word(text))
        else:
            known = self._cache.get
            for w in self._words.findall(text):
                out.extend(known(w) or self._word(w))
        if not self.byte:  # neighbouring unknown characters share one id
            out = [x for k, x in enumerate(out) if x != self.unk or k == 0 or out[k - 1] != self.unk]
        return out

    def decode(self, ids) -> bytes:
        """UTF-8 bytes of a sequence of ids."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        lens = self._lens[ids]
        ends = np.cumsum(lens)
        at = np.repeat(self._starts[ids] - ends + lens, lens) + np.arange(ends[-1])
        out = self._flat[at].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


_CODECS: dict[bytes, Codec] = {}  # of this worker, by digest of the model


def codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def load_model(spark: SparkSession, path: str = MODEL):
    """The model file's bytes as a broadcast variable (driver-side file, bounded size)."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the text decoded from the ids) and round_trip
    (it equals the text, U+2581 read as a space) of every document."""
    model = load_model(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        space = SPACE.encode()

        def out(rows) -> pa.RecordBatch:
            doc, arrays, sha, same = zip(*rows)
            offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), ids, pa.array(sha), pa.array(same)],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py() or ""
                ids = np.array(c.encode(text), np.int32)
                back = c.decode(ids)
                rows.append((doc_id.as_py(), ids, hashlib.sha256(back).hexdigest(),
                             back == text.encode().replace(space, b" ")))
                size += len(ids)
                if size >= _OUT_IDS:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    d = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return d.mapInArrow(run, _SCHEMA)


def decoded(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``tokens`` (doc_id, ids) -> doc_id, text."""
    model = load_model(tokens.sparkSession, model_path)

    def known(c: Codec, ids: list | None) -> list[int]:
        n = len(c._names)
        return [i if i is not None and 0 <= i < n else c.unk for i in ids or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in batches:
            text = [c.decode(known(c, x.as_py())).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id AS bigint) AS doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
