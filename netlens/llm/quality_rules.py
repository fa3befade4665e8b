"""Line-first quality rules (operator 4), DataFrame expressions only.

Each line of a text is judged on its own by three rules (punctuation, navigation,
boilerplate); failing lines are removed, and a document that loses more than a given
share of its word characters is rejected. Everything is computed inside a row, so the
plan is one scan without a shuffle, whatever the size or the skew of the table.

Defined results: a null or blank text has no words, so it fails the base rule
(``n_words < 10``) and its ``clean_text`` is ''. Repeated rows and repeated ids are
judged row by row. Extra input columns, whatever their names, ride along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, WHITE, WHITE_RUN, WORD_CHAR, apart, table, words_of

SYMBOLS = r"[#*$%&|<>]"
LOUD = r"[!?#*$%&|<>]"  # what a line of prose holds little of
MARKERS = r"^[\x20\x09-\x0D]*[#*]{1,6}[\x20\x09]+"  # headings and list items of markdown
SHOUTED = r"!!|\?\?|[#*$%&<>]{3}|\|"  # no single marks of prose; a bar separates cells or links
SEPARATORS = r"[|»›·•]"
NAVIGATION = (r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign ?(in|up)|skip to (main )?content|next|previous"
              r"|back to top|read more|share this|subscribe|search|contact us|about us)[\x20\x09-\x0D]*$")
BOILERPLATE = (r"(?i)(all rights reserved|cookie policy|accept (all )?cookies|we use cookies"
               r"|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
               r"|click here|powered by)")

WINDOW = 5               # words in a repetition window
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20  # of the words, inside windows seen twice or more
MAX_LOUD_PERCENT = 10    # of a line's characters
MIN_LOUD = 5             # in a line, to call it loud if nothing in it is shouted
MIN_BOILERPLATE_PERCENT = 20  # of a line's characters, in such phrases
MIN_SEPARATORS = 3       # in a line, to call it a navigation bar
MAX_LOST_PERCENT = 50    # of the word characters, removed with failing lines


def _n_matches(text: Column, cls: str) -> Column:
    """Characters of ``text`` in the one-character class ``cls``."""
    return F.length(text) - F.length(F.regexp_replace(text, cls + "+", ""))


def line_passes(line: Column) -> Column:
    """The three rules on one line that has a word."""
    over = _n_matches(line, LOUD) * 100 > F.length(line) * MAX_LOUD_PERCENT
    rest = F.regexp_replace(line, MARKERS, "")
    n = _n_matches(rest, LOUD)
    loud = over & (n * 100 > F.length(line) * MAX_LOUD_PERCENT) & ((n >= MIN_LOUD) | rest.rlike(SHOUTED))
    punctuation = ~loud & line.rlike(r"[\p{L}\p{N}]")
    navigation = (_n_matches(line, SEPARATORS) >= MIN_SEPARATORS) | line.rlike(NAVIGATION)
    # a phrase inside a paragraph is part of its prose
    boilerplate = line.rlike(BOILERPLATE) \
        & ((F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))) * 100
           >= F.length(F.btrim(line, F.lit(WHITE))) * MIN_BOILERPLATE_PERCENT)
    return punctuation & ~navigation & ~boilerplate


def _repeated_words(n: Column, hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. ``hashes`` holds the
    64-bit hash of every window in text order."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        starts = F.sort_array(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                     | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)), lambda x: x["i"]))
        state = F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"),
                                  (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n")))
        return state["n"]

    # a one-element array binds the sorted list to a variable, so it is sorted once
    return F.transform(F.array(order), covered)[0]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Base measures, verdict and cleaned text of every row of ``docs``.

    Returns ``row`` (struct of all input columns) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines_removed, lost_chars, base_failed, kept,
    clean_text. Repeated lines are removed after their first copy."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("row", "t", words_of(F.col("t")).alias("words"),
                 F.split(F.col("t"), "\n", -1).alias("lines"))
    d = d.select("row", "t", "lines", F.size("words").alias("n"),
                 F.length(F.array_join("words", "")).alias("word_chars"),
                 F.filter("lines", lambda x: x.rlike(WORD_CHAR)).alias("full"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    wh = F.col("wh")
    windows = F.when(F.col("n") >= WINDOW, F.transform(
        F.slice(wh, 1, F.greatest(F.size(wh) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(wh, i + k) for k in range(1, WINDOW)]))) \
        .otherwise(F.array().cast("array<bigint>"))
    d = d.select("row", "t", "lines", "n", "word_chars", "full", F.array_distinct("full").alias("once"),
                 windows.alias("hashes"))
    d = d.select(
        "row", "t", "n", "word_chars",
        (F.size("full") - F.size("once")).alias("dup"), F.size("full").alias("n_full"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0))
        .otherwise(_repeated_words(F.col("n"), F.col("hashes"))).alias("rep"),
        # without repeated lines the blank lines between paragraphs stay where they are
        F.when(F.size("full") == F.size("once"),
               F.filter("lines", lambda x: ~x.rlike(WORD_CHAR) | line_passes(x)))
        .otherwise(F.filter("once", line_passes)).alias("left"),
        F.size("lines").alias("n_lines"))
    d = d.select("*", F.size(F.filter("left", lambda x: x.rlike(WORD_CHAR))).alias("n_left"),
                 F.array_join("left", "\n").alias("clean"))
    lost = F.when(F.col("n_left") == F.col("n_full"), F.lit(0)).otherwise(
        F.col("word_chars") - F.length(F.regexp_replace("clean", WHITE_RUN, "")))
    d = d.select("*", lost.alias("lost"),
                 ((F.col("n") < MIN_WORDS)
                  | (100 * F.col("rep") > MAX_REPEAT_PERCENT * F.col("n"))).alias("bad"))
    return apart(d.select(
        "row", F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        _n_matches(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"),
        F.col("rep").cast("long").alias("n_repeat_words"),
        (F.col("n_full") - F.col("n_left")).cast("long").alias("n_lines_removed"),
        F.col("lost").cast("long").alias("lost_chars"),
        F.col("bad").alias("base_failed"),
        (~F.col("bad") & (100 * F.col("lost").cast("long")
                          <= MAX_LOST_PERCENT * F.col("word_chars").cast("long"))).alias("kept"),
        F.col("clean").alias("clean_text")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failing lines removed from ``text`` (and ``n_chars``
    brought up to date); the columns of ``documents``."""
    return measure(docs).where("kept").select(
        "row.doc_id", F.col("clean_text").alias("text"), "row.lang", "row.source",
        F.length("clean_text").cast("long").alias("n_chars")).select(DOCUMENT_COLUMNS)


def report(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document."""
    return measure(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines_removed", "lost_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


# DuckDB statement of measure() over a relation {docs}(doc_id, text)
MEASURE_SQL = r"""
t0 AS (SELECT *, coalesce(text, '') AS t FROM {docs}),
t1 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(t, chr(10)) AS lines FROM t0),
t2 AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM t1),
wins AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM t2 WHERE len(words) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS w FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM keyed) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lined AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM t2)),
measured_lines AS (SELECT *, length(line) - length(regexp_replace(line, '[!?#*$%&|<>]', '', 'g')) AS loud_all,
    length(rest) - length(regexp_replace(rest, '[!?#*$%&|<>]', '', 'g')) AS loud,
    length(line) - length(regexp_replace(line, '(?i)(all rights reserved|cookie policy|accept (all )?cookies|we use cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|click here|powered by)', '', 'g')) AS phrases
    FROM (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]*[#*]{{1,6}}[\x20\x09]+', '') AS rest FROM lined)),
judged AS (SELECT doc_id, k, line, NOT regexp_matches(line, '[^\x20\x09-\x0D]') AS blank,
    NOT (loud_all * 100 > length(line) * 10 AND loud * 100 > length(line) * 10
      AND (loud >= 5 OR regexp_matches(rest, '!!|\?\?|[#*$%&<>]{{3}}|\|')))
    AND regexp_matches(line, '[\p{{L}}\p{{N}}]')
    AND length(line) - length(regexp_replace(line, '[|»›·•]', '', 'g')) < 3
    AND NOT regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|log ?out|sign ?(in|up)|skip to (main )?content|next|previous|back to top|read more|share this|subscribe|search|contact us|about us)[\x20\x09-\x0D]*$')
    AND NOT (phrases > 0 AND phrases * 100 >= length(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) * 20) AS ok,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS copy FROM measured_lines),
rejoined AS (SELECT doc_id, count(*) FILTER (NOT blank) AS n_full, count(*) FILTER (NOT blank AND copy > 1) AS dup,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (blank OR ok), '') AS with_blanks,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT blank AND ok AND copy = 1), '') AS without,
    count(*) FILTER (NOT blank AND ok AND copy = 1) AS n_left FROM judged GROUP BY doc_id),
m0 AS (SELECT t2.*, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, r.dup::BIGINT AS n_dup_lines,
    coalesce(reps.n, 0)::BIGINT AS n_repeat_words, (n_full - n_left)::BIGINT AS n_lines_removed,
    CASE WHEN r.dup = 0 THEN with_blanks ELSE without END AS clean_text
    FROM t2 JOIN rejoined r USING (doc_id) LEFT JOIN reps USING (doc_id)),
m1 AS (SELECT *, (word_chars - length(regexp_replace(clean_text, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS lost_chars,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
measured AS (SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM m1)"""

ORACLE = ("WITH " + MEASURE_SQL.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
       n_lines_removed, lost_chars FROM measured""")
