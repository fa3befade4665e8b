"""Secret scan (operator 3), DataFrame expressions only.

Base patterns give the spans ``assign``, ``access`` and ``hex``. The entropy pass adds
spans of kind ``entropy``: candidate strings are classed by their alphabet (hex, base32, upper
or lower case with digits, base64), a window of 32 symbols (20 for candidates of 20 to 31)
slides over each one while a per-symbol count array is updated by the symbol that enters
and the symbol that leaves, and a candidate is reported when the Shannon entropy of some
window reaches the threshold of its class, unless the allow list names it or a base span
already overlaps it. The entropy sum is kept in integers (millionths of a bit), so the
decision does not depend on the order of floating-point additions.

Everything is computed inside a row: one scan, no shuffle. Positions are code points, end
exclusive. Defined results: null and empty texts have no spans (``base_sha256`` is the
digest of the empty string); repeated rows are scanned one by one; extra columns ride
along in ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, apart, table

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ASSIGN_MIN = 12                      # characters of the value
ACCESS = r"AKIA[A-Z0-9]{14,}"        # 18 characters or more
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]  # order of spans that start together

WINDOW = 32
HEX_TEXT = r"^[0-9A-Fa-f]+$"
# class -> (alphabet, least entropy of a window in bits); case is folded for hex
HEX_CLASS = ("0123456789abcdef", 3.0)
BASE64_CLASS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 4.2)

# Shorter candidates in a window of their own, and thresholds by alphabet, which at most 1 % of
# random strings as long as the window miss (base64 in 32: about 1 %).
SHORT_WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"  # SHORT_WINDOW characters or more
# class -> (pattern, least entropy in 32, least entropy in 20), first match; signs that join parts
# do not count as symbols of the smaller alphabets
CLASSES = [
    (HEX_TEXT, HEX_CLASS[1], 2.85),
    (r"^[A-Z2-7_-]+$", 3.8, 3.3),
    (r"^[A-Z0-9_-]+$", 3.85, 3.35),
    (r"^[a-z0-9_-]+$", 3.85, 3.35),
    (r"", BASE64_CLASS[1], 3.6),
]

# strings that look random but are no secrets
LOOKALIKES = "|".join([
    r"^[^0-9]*$",                                       # words and identifiers: no digit
    r"^[0-9+/_-]+$",                                    # numbers, dates, rules
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^sha(1|256|384|512)[-_]",                         # integrity digests
])
# Long base64 and webhook URLs hold four slashes too, and secrets stand beside words of samples and
# alphabets, so paths and samples are judged by their parts as well.
SLASHES = r"(/[A-Za-z0-9_-]*){4}"
SAMPLES = r"(?i)example|placeholder|xxxx|abcdefghij|0123456789"

PART_ENDS = r"[/+_-]"
# a part like a word: three characters at most; or runs of two letters or more with numbers, of
# which one at most stands between letters. Possessive, and bounded by the part's length.
WORDY = (r"^(?:[A-Za-z0-9]{0,3}|(?=.{4,40}$)(?![A-Za-z]*[0-9]+[A-Za-z]+[0-9]+[A-Za-z])"
         r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)++)$")
ODD_MIN = 12                         # characters in other parts, from which a string is not wordy

_UNIT = 1_000_000
_C_LOG_C = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 1)]


def most_sum(bits: float, window: int = WINDOW) -> int:
    """Largest sum of c * log2(c) over a window's counts (in millionths) at which its
    entropy, log2(W) - sum / W, is still ``bits`` or more."""
    return round(window * (math.log2(window) - bits) * _UNIT)


def _reaches(text: Column, alphabet: str, window: int, most: Column) -> Column:
    """Some window of ``text`` has a sum of c * log2(c) of ``most`` or less. The state holds the
    counts of the current window; each step changes the two symbols that move, until one does."""
    table_ = F.array(*[F.lit(x).cast("bigint") for x in _C_LOG_C])
    n = len(alphabet)

    def slide(symbols: Column) -> Column:
        left = F.slice(F.concat(F.array_repeat(F.lit(0), window), symbols), 1, F.size(symbols))
        steps = F.zip_with(symbols, left, lambda i, o: F.struct(i.alias("i"), o.alias("o")))
        start = F.struct(F.array_repeat(F.lit(0), n + 1).alias("c"), F.lit(0).cast("bigint").alias("s"),
                         F.lit(2 ** 62).cast("bigint").alias("least"), F.lit(0).alias("k"))

        def step(a: Column, x: Column) -> Column:
            c_out = F.get(a["c"], x["o"])
            gone = F.when(x["o"] > 0, F.get(table_, c_out) - F.get(table_, c_out - 1)) \
                .otherwise(F.lit(0).cast("bigint"))
            c_in = F.get(a["c"], x["i"]) - F.when(x["i"] == x["o"], 1).otherwise(0)
            s = a["s"] - gone + F.get(table_, c_in + 1) - F.get(table_, c_in)
            counts = F.when(x["i"] == x["o"], a["c"]).otherwise(F.transform(
                a["c"], lambda v, j: F.when(j == x["i"], v + 1)
                .when((j == x["o"]) & (x["o"] > 0), v - 1).otherwise(v)))
            return F.when(a["least"] <= most, a).otherwise(F.struct(
                counts.alias("c"), s.alias("s"),
                F.when(a["k"] >= window - 1, F.least(a["least"], s)).otherwise(a["least"]).alias("least"),
                (a["k"] + 1).alias("k")))

        return F.aggregate(steps, start, step)["least"] <= most

    symbols = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    return F.transform(F.array(symbols), slide)[0]


def is_wordy(text: Column, known: str | None = None) -> Column:
    """Fewer than ``ODD_MIN`` characters stand in parts that are neither like words nor hold
    ``known``."""
    odd = F.filter(F.split(text, PART_ENDS, -1), lambda p: ~p.rlike(WORDY) if known is None else ~(p.rlike(WORDY) | p.rlike(known)))
    return F.length(F.array_join(odd, "")) < ODD_MIN


def is_random(text: Column) -> Column:
    """Entropy rule of the candidate's class and length, after the allow list. A string of words
    reaches the thresholds of the shorter window and of the smaller alphabets by chance, so it
    needs 32 characters and the threshold of base64 text."""
    folded = F.when(text.rlike(HEX_TEXT), F.lower(text)).otherwise(text)
    reaches = lambda window, most: F.transform(F.array(F.struct(folded.alias("t"), most.alias("m"))), lambda x: _reaches(
        x["t"], BASE64_CLASS[0], window, x["m"]))[0]
    most = lambda at, window: F.coalesce(*[
        F.when(text.rlike(c[0]), F.lit(most_sum(c[at], window))) for c in CLASSES]).cast("bigint")
    whole = F.when(is_wordy(text) & ~text.rlike(HEX_TEXT), F.lit(most_sum(BASE64_CLASS[1])).cast("bigint")).otherwise(most(1, WINDOW))
    return F.when(text.rlike(LOOKALIKES) | (text.rlike(SLASHES) & is_wordy(text)) | (text.rlike(SAMPLES) & is_wordy(text, SAMPLES)), F.lit(False)) \
        .when(F.length(text) >= WINDOW, reaches(WINDOW, whole)) \
        .otherwise(~is_wordy(text) & reaches(SHORT_WINDOW, most(2, SHORT_WINDOW)))


_SPAN = "struct<s:int,k:int,e:int,text:string>"
_BLOCK = 32  # items of a block in running sums


def _bind(x: Column, f) -> Column:
    """``f`` of a value that is made once: the value becomes a lambda's variable."""
    return F.transform(F.array(x), f)[0]


def _running(values: Column, whole, join, levels: int = 2) -> Column:
    """For every place, ``whole`` of the values before it, by blocks, blocks of blocks and so on. A
    fold with a list in its state would copy the list at every step."""
    def before(x: Column, level: int) -> Column:
        places = F.sequence(F.lit(0), F.size(x) - 1)
        if not level:
            return F.transform(places, lambda i: whole(F.slice(x, F.lit(1), i)))
        number = lambda i: F.floor(i / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), number(F.size(x) - 1)), lambda b: whole(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        return _bind(blocks, lambda bs: _bind(before(bs, level - 1), lambda sums: F.transform(places, lambda i: join(
            F.get(sums, number(i)), whole(F.slice(x, number(i) * _BLOCK + 1, i % _BLOCK))))))

    return _bind(values, lambda x: F.when(F.size(x) > 0, before(x, levels)).otherwise(F.array().cast("array<int>")))


def _sums(values: Column) -> Column:
    return _running(values, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v), lambda a, b: a + b)


def _maxima(values: Column) -> Column:
    return _running(values, lambda x: F.coalesce(F.array_max(x), F.lit(0)), F.greatest)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<s, k, e, text>> of the leftmost non-overlapping matches: the lengths of the
    pieces between matches give the positions."""
    def spans(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.struct(
            F.length(p).alias("p"), F.length(m).alias("m")))
        return _bind(lengths, lambda n: _bind(_sums(F.transform(n, lambda y: y["p"] + y["m"])), lambda at: F.transform(
            x["m"], lambda m, i: F.struct((F.get(at, i) + F.get(n, i)["p"]).alias("s"), F.lit(KINDS.index(kind)).alias("k"),
                                          (F.get(at, i) + F.get(n, i)["p"] + F.get(n, i)["m"]).alias("e"), m.alias("text")))))

    found = _bind(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), spans)
    return F.coalesce(F.when(text.rlike(pattern), found), F.array().cast(f"array<{_SPAN}>"))


def _overlaps(span: Column, kind: Column) -> Column:
    """Some span of one ``kind`` (sorted, none overlapping another) overlaps ``span``: by bisection,
    the first that ends after its start begins before its end."""
    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(kind, mid)["e"] <= span["s"]
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(kind) + 1)).cast("int"))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(kind).alias("hi")), step, lambda a: a["lo"])
    return (F.size(kind) > 0) & F.coalesce(F.get(kind, first)["s"] < span["e"], F.lit(False))


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (struct of all input columns), ``t`` (the text, null as ''), ``base`` and ``found`` (all
    spans): arrays of struct(s, k, e) in order of start, then kind. Time grows with the length of a
    text, however many matches it holds."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    # group 2 of the assign match is its longest tail of value characters after [:=], quote
    value = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
    assign = F.filter(_matches(t, ASSIGN, "assign"),
                      lambda x: F.length(F.regexp_extract(x["text"], value, 1)) >= ASSIGN_MIN)
    d = d.select("row", "t", assign.alias("assign"), _matches(t, ACCESS, "access").alias("access"),
                 _matches(t, HEX, "hex").alias("hex"), _matches(t, CANDIDATE, "entropy").alias("cand"))
    free = F.filter("cand", lambda c: ~_overlaps(c, F.col("assign")) & ~_overlaps(c, F.col("access"))
                    & ~_overlaps(c, F.col("hex")) & is_random(c["text"]))
    d = d.select("row", "t", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), free.alias("free"))
    d = d.select("row", "t", "base", F.when(F.size("free") > 0, F.array_sort(F.concat("base", "free")))
                 .otherwise(F.col("base")).alias("found"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return apart(d.select("row", "t", bare("base").alias("base"), bare("found").alias("found")))


_PIECE = 1024  # code points; a substring is cut from its pieces, not counted from the text's start


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text that ``pieces`` make up."""
    def part(b: Column) -> Column:
        first = F.greatest(start - b * _PIECE, F.lit(0))
        return F.substring(F.get(pieces, b), first + 1, F.least(end - b * _PIECE, F.lit(_PIECE)) - first)

    numbers = F.sequence(F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int"))
    return F.when(end > start, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame) -> DataFrame:
    """All documents, each secret replaced by ``[SECRET]`` (overlapping spans by one); the
    columns of ``documents``, with ``n_chars`` brought up to date where a text changed."""
    some = F.size("found") > 0
    d = scan(docs).select("row", "t", "found", F.when(some, F.regexp_extract_all(
        "t", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).alias("pieces"),
        F.when(some, _maxima(F.transform("found", lambda x: x["e"]))).alias("ends"))
    pieces = F.col("pieces")
    # a span that begins before an earlier one ends is part of its replacement
    changed = F.transform("found", lambda x, i: F.when(x["s"] < F.get(F.col("ends"), i), F.lit("")).otherwise(
        F.concat(_between(pieces, F.get(F.col("ends"), i), x["s"]), F.lit("[SECRET]"))))
    last = F.array_max(F.transform("found", lambda x: x["e"]))
    d = d.select("row", some.alias("some"), F.when(some, F.concat(F.array_join(changed, ""), _between(pieces, last, F.length("t"))))
                 .otherwise(F.col("row.text")).alias("clean"))
    return d.select("row.doc_id", F.col("clean").alias("text"), "row.lang", "row.source",
                    F.when(F.col("some"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")) \
        .select(DOCUMENT_COLUMNS)


def report(docs: DataFrame) -> DataFrame:
    """Counts and spelled spans of every document."""
    d = scan(docs.select("doc_id", "text"))
    count = lambda col, k: F.size(F.filter(col, lambda x: x["k"] == KINDS.index(k))).cast("long")
    return d.select("row.doc_id", count("base", "assign").alias("n_assign"), count("base", "access").alias("n_access"),
                    count("base", "hex").alias("n_hex"),
                    F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"),
                    _spelled(F.col("found")).alias("spans"), count("found", "entropy").alias("n_entropy"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same rules for DuckDB, whose patterns know no look-ahead: ``WORDY`` is three conditions."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    has = lambda x, p: f"regexp_matches({x}, {quoted(p)})"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {KINDS.index(k)} AS k, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS p,"
        f" regexp_extract_all(t, {quoted(p)}, {2 if k == 'assign' else 0}) AS g FROM t WHERE {has('t', p)}"
        for k, p in patterns.items())
    wordy = (f"({has('p', '^[A-Za-z0-9]{0,3}$')} OR (length(p) BETWEEN 4 AND 40 AND NOT {has('p', '^[A-Za-z]*[0-9]+[A-Za-z]+[0-9]+[A-Za-z]')} "
             f"AND {has('p', '^([A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+)+$')}))")
    odd = lambda known: (f"length(array_to_string(list_filter(string_split_regex(x, {quoted(PART_ENDS)}), "  # noqa: E731
                         f"lambda p: NOT ({wordy}{known})), ''))")
    bits = lambda at: "CASE " + " ".join(f"WHEN {has('x', c[0])} THEN {c[at]}" for c in CLASSES) + " END"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
spans0 AS (SELECT doc_id, k, m[i] AS x, length(g[i]) AS value_chars,
    (list_sum([length(y) for y in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i-1]]), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
spans1 AS (SELECT doc_id, k, x, s, s + length(x) AS e FROM spans0 WHERE k <> 0 OR value_chars >= {ASSIGN_MIN}),
base AS (SELECT doc_id, k, s, e FROM spans1 WHERE k < 3),
parts AS (SELECT *, {odd('')} < {ODD_MIN} AS wordy, {odd(' OR ' + has('p', SAMPLES))} < {ODD_MIN} AS sample, {has('x', HEX_TEXT)} AS hex
  FROM spans1 c WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
cand AS (SELECT *, CASE WHEN length(x) >= {WINDOW} THEN {WINDOW} ELSE {SHORT_WINDOW} END AS w, CASE WHEN length(x) < {WINDOW} THEN {bits(2)}
    WHEN wordy AND NOT hex THEN {BASE64_CLASS[1]} ELSE {bits(1)} END AS least FROM parts
  WHERE NOT ({has('x', LOOKALIKES)} OR ({has('x', SLASHES)} AND wordy) OR ({has('x', SAMPLES)} AND sample)
    OR (length(x) < {WINDOW} AND wordy))),
wins AS (SELECT doc_id, k, s, e, least, unnest([list_aggregate(string_split(substr(x, i, w), ''), 'entropy')
            for i in range(1, length(x) - w + 2)]) AS h
  FROM (SELECT * EXCLUDE x, CASE WHEN hex THEN lower(x) ELSE x END AS x FROM cand)),
entropy AS (SELECT DISTINCT doc_id, k, s, e FROM wins WHERE h >= least - 1e-6),
spelled AS (SELECT doc_id, k, s, {KINDS}[k + 1] || ':' || s || ':' || e AS x FROM (FROM base UNION ALL FROM entropy)),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    count(*) FILTER (k = 3) AS d, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base_, string_agg(x, ',' ORDER BY s, k) AS spans
  FROM spelled GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
    sha256(coalesce(base_, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(d, 0) AS n_entropy
FROM t LEFT JOIN per USING (doc_id)"""


ORACLE = _oracle()
