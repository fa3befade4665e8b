"""Merkle dataset manifest (operator 12): a tree of SHA-256 digests over all rows, with a proof for
each of them.

Leaves are the digests of the rows. Inside a source they are ranked by doc_id; every 16
consecutive nodes make the next level, until one is left, the source's subroot. The subroots,
ranked by source, are the leaves of a second tree of the same kind, whose top is the root.

Nested-interval labels: every node carries the interval [lo, hi) of the leaf ranks it covers, so
a node's ancestors are the nodes whose intervals contain its own, and no node needs to know its
children by name.

1. Leaves are ranked by ranges (``ranks``): one shuffle of ids and digests, not of texts.
2. Levels go up by one aggregate each, keyed by (group, lo / 16 ** level): sixteen rows a key, so a
   source of any size is many keys. A run of one node that begins at 0 is the whole of its group:
   it is the top. A level is a sixteenth of the one below.
3. Ancestors come down by level-bucketed containment joins: a node meets the node one level up in
   the bucket of its interval that contains it, and takes over that node's path to the root.
   Inside the parent its siblings are what is left of the parent's interval without its own:
   those before it and those after it, which is one step of the proof.
4. The lowest runs hold their leaves' rows, so these get their steps without another shuffle.

Defined results: null fields are ``-``; rows without source are a source of their own, first in
order; rows without doc_id come first in their source and are never tampered with; rows that tie
in doc_id are in order of their leaf digest; equal rows are separate leaves, in any order; extra
columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, crc_mod, stored, table
from .ranks import ranked
from .sql import CRC_TABLE, LOWER, crc32

FAN_OUT = 16
_BITS = FAN_OUT.bit_length() - 1
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED_ONE_IN = 5

_STEPS = "array<struct<before:string,after:string>>"  # of a proof, from the leaf's side up


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_text(fields: list[Column]) -> Column:
    """``-`` or byte count, ``:`` and value of each field, concatenated."""
    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.concat(*[one(c) for c in fields])


def leaves(docs: DataFrame, tampered_one_in: int = TAMPERED_ONE_IN) -> DataFrame:
    """group (the source), doc_id, h (leaf digest) and t (digest of the tampered row, or null)."""
    fields = {c: F.col(c) for c in LEAF_FIELDS}
    lowered = fields | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    tampered = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), tampered_one_in) == 0)
    return docs.select(F.col("source").alias("group"), "doc_id", digest(leaf_text(list(fields.values()))).alias("h"),
                       F.when(tampered, digest(leaf_text(list(lowered.values())))).alias("t"))


def _bucket(level: int, c: str = "lo") -> Column:
    """Number of the interval of ``FAN_OUT ** level`` ranks that holds ``c``."""
    return F.shiftright(F.col(c), _BITS * level)


def _runs(nodes: DataFrame, level: int, row: Column) -> DataFrame:
    """group, lo, hi, h, kids and top of the runs of ``level``; kids are the ``row`` structs (first
    lo, hi, h) in order. ``top``: the run is a single node that is all of its group, and h is its."""
    kids = F.array_sort(F.collect_list(row))
    runs = nodes.groupBy("group", _bucket(level).alias("bucket")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
    hashes = F.transform("kids", lambda x: x["h"])
    top = (F.size("kids") == 1) & (F.col("bucket") == 0)
    return runs.select("group", "lo", "hi", F.when(top, F.get(hashes, F.lit(0))).otherwise(
        digest(F.array_join(hashes, ""))).alias("h"), "kids", top.alias("top"))


def levels(nodes: DataFrame, row: Column, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level over ``nodes`` (group, lo, hi, h and what ``row`` takes), lowest
    first, and the tops (group, level, h); a group's top is in the runs of its level + 1 too, as
    a lone kid."""
    out, tops, level = [], None, 0
    while True:
        level += 1
        runs = stored(_runs(nodes, level, row), f"{name}-level{level}")
        out.append(runs)
        top = runs.where("top").select("group", F.lit(level - 1).alias("level"), "h")
        tops = top if tops is None else tops.unionByName(top)
        nodes = runs.where("NOT top").select("group", "lo", "hi", "h")
        if nodes.isEmpty():
            return out, tops
        row = F.struct("lo", "hi", "h")


def step(kids: Column, lo: Column, hi: Column) -> Column:
    """Siblings of the kid [lo, hi): the digests before and after it among ``kids``."""
    side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda x: x["h"]), "")
    return F.struct(side(lambda x: x["hi"] <= lo).alias("before"), side(lambda x: x["lo"] >= hi).alias("after"))


def with_paths(runs: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The lowest runs with ``steps``: the proof of the run's own digest, and the columns of
    ``paths`` (group, steps of the group's top, and others)."""
    known = paths.columns[1:]
    above = None
    for level in range(len(runs), 0, -1):
        d = runs[level - 1]
        p = paths.withColumnRenamed("group", "g")
        done = d.where("top").join(p, F.col("group").eqNullSafe(F.col("g"))).drop("g")
        if above is not None:
            up = above.select(
                F.col("group").alias("g"), _bucket(level + 1).alias("b"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"),
                F.col("kids").alias("up_kids"), F.col("top").alias("up_top"), *known)
            inside = F.col("group").eqNullSafe(F.col("g")) & (_bucket(level + 1) == F.col("b")) \
                & (F.col("lo") >= F.col("up_lo")) & (F.col("hi") <= F.col("up_hi"))
            own = F.array(step(F.col("up_kids"), F.col("lo"), F.col("hi"))).cast(_STEPS)
            steps = F.when(F.col("up_top"), F.col("steps")).otherwise(F.concat(own, F.col("steps")))
            rest = d.where("NOT top").join(up, inside).withColumn("steps", steps).select(*d.columns, *known)
            d = done.select(*d.columns, *known).unionByName(rest)
        else:
            d = done.select(*d.columns, *known)
        above = d
    return above


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its proof give."""
    return F.aggregate(steps, leaf, lambda h, x: digest(F.concat(x["before"], h, x["after"])))


def manifest(docs: DataFrame, tampered_one_in: int = TAMPERED_ONE_IN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; every
    ``tampered_one_in``-th id (by CRC-32) is folded from its lower-cased text."""
    # stored first: ranking samples its input, and would read and hash the texts twice
    own = stored(leaves(docs.select(*DOCUMENT_COLUMNS), tampered_one_in), "merkle-digests")
    rows = ranked(own, ["group"], ["doc_id", "h"], "merkle-leaves")
    low, tops = levels(rows.select("*", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi")),
                       F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "h", "t", "doc_id"), "merkle")
    subroots = ranked(tops.select("group", "h"), [], ["group"], "merkle-subroots")
    high, root = levels(subroots.select(F.lit(0).alias("group"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"),
                                        "h", F.col("group").alias("source")),
                        F.struct("lo", "hi", "h", F.col("source")), "merkle-top")
    top = root.select("group", F.array().cast(_STEPS).alias("steps"), F.col("h").alias("root"))
    paths = with_paths(high, top)
    paths = paths.select(F.explode("kids").alias("x"), "kids", "top", "steps", "root")
    paths = stored(paths.select(
        F.col("x.source").alias("group"), _steps_of(F.col("x")).alias("steps"), F.col("x.h").alias("subroot"), "root"), "merkle-paths")
    d = with_paths(low, paths).select(F.explode("kids").alias("x"), "kids", "top", "steps", "subroot", "root")
    d = d.select(F.col("x.doc_id"), F.col("x.h").alias("leaf"), F.col("x.t").alias("t"), "subroot", "root", _steps_of(F.col("x")).alias("steps"))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    d = d.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"),
                 folded(F.coalesce("t", "leaf"), F.col("steps")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def _steps_of(kid: Column) -> Column:
    """Proof of one of the ``kids`` of a run: its step, then the run's; a lone top has no step."""
    own = F.array(step(F.col("kids"), kid["lo"], kid["hi"])).cast(_STEPS)
    return F.when(F.col("top"), F.col("steps")).otherwise(F.concat(own, F.col("steps")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_ORACLE_LEVELS = 6  # of the statement, which has no loop: 16 ** 6 rows a source, as many sources


def _oracle() -> str:
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in LEAF_FIELDS) + ")"

    def tree(name: str, nodes: str) -> str:
        """Levels over ``nodes`` (g, i, h): per node its digest p and siblings one level up."""
        out, below = [], nodes
        for k in range(1, _ORACLE_LEVELS + 1):
            around = f"PARTITION BY g, i // {FAN_OUT} ORDER BY i ROWS BETWEEN"
            out.append(f"""
{name}{k}_in AS (SELECT *, count(*) OVER (PARTITION BY g) AS n,
    coalesce(string_agg(h, '') OVER ({around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(h, '') OVER ({around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {below}),
{name}{k} AS (SELECT g, i // {FAN_OUT} AS i,
    CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {name}{k}_in GROUP BY g, i // {FAN_OUT})""")
            below = f"{name}{k}"
        return ",".join(out)

    def joins(name: str, group: str, place: str) -> str:
        return "\n".join(
            f"JOIN {name}{k}_in AS {name}{k}x ON {name}{k}x.g IS NOT DISTINCT FROM {group} AND {name}{k}x.i = {place} // {FAN_OUT ** (k - 1)}"
            for k in range(1, _ORACLE_LEVELS + 1))

    steps = [f"{name}{k}x" for name in ("s", "r") for k in range(1, _ORACLE_LEVELS + 1)]
    proof = " || ".join(f"{x}.b || {x}.a" for x in steps)
    fold, folds = "coalesce(t, leaf)", []
    for k, x in enumerate(steps):
        folds.append(f"f{k} AS (SELECT *, CASE WHEN n_{x} = 1 THEN {fold} ELSE sha256(b_{x} || {fold} || a_{x}) END AS fold{k} "
                     f"FROM {f'f{k - 1}' if k else 'paths'})")
        fold = f"fold{k}"
    cols = ", ".join(f"{x}.n AS n_{x}, {x}.b AS b_{x}, {x}.a AS a_{x}" for x in steps)
    top = f"{_ORACLE_LEVELS}"
    return f"""
WITH {CRC_TABLE},
leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % {TAMPERED_ONE_IN} = 0 THEN {leaf(LOWER)} END AS t FROM documents, crc_table),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM leaves),
low AS (SELECT source AS g, i, leaf AS h FROM ranks),
{tree("s", "low").lstrip()},
subroots AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM s{top}),
high AS (SELECT 0 AS g, place AS i, subroot AS h FROM subroots),
{tree("r", "high").lstrip()},
paths AS (SELECT ranks.doc_id, leaf, t, subroot, r{top}.h AS root, sha256({proof}) AS proof_sha256, {cols}
  FROM ranks JOIN subroots ON subroots.source IS NOT DISTINCT FROM ranks.source CROSS JOIN r{top}
{joins("s", "ranks.source", "ranks.i")}
{joins("r", "0", "subroots.place")}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM f{len(steps) - 1}"""


ORACLE = _oracle()
