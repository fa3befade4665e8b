"""Mixing sources to target weights by pivotal dependent rounding (operator 6),
DataFrame expressions only.

A source with target / size = r gives each of its documents floor(r) copies and a
fractional copy with probability p = r - floor(r). The fractional probabilities are rounded
pairwise: two documents meet, a random direction is drawn, and as many words of probability
mass as possible move from one to the other, so that one of them becomes integral while
p1*size1 + p2*size2 and both expectations stay as they were. The survivor meets the next
document. Documents are dealt to buckets of about ``FAN_IN`` by a hash; every bucket is
folded in one task and leaves one residual; the residuals are dealt to buckets again, level
by level, until one per source is left, which is drawn by its own probability. So a source's
taken words differ from its target by less than the size of one document. Within a bucket the
largest documents meet first, so the one that is left is mostly a small one; one bucket of each
source waits for the last level, where its small documents round off what the others left.

A document much larger than its source's mean would stay undecided to the end, as every smaller
one it meets becomes integral first. So such documents are paired with all others of the source
at once: each is drawn by p, and the words this adds or takes are moved from or to the others in
equal shares of their p, which keeps the sum and all expectations. They are taken from the
largest down while the others can balance any outcome.

Only (key, id, size, p) rows are shuffled; a hot source is many buckets. Draws are hashes of
the document's key and of its number among equal rows, so reruns and retried tasks agree, and
equal rows, however many, are spread over the buckets.

Defined results: null text has size 0; null source is a source of its own, last in order; a
document without words takes no words. Rows that are equal in all columns are separate documents
with the same key; an empty table gives no rows. A table without words has all
targets 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, cut, identity, stored, table, words_of

WEIGHTS = (5, 2, 1)   # by order of source, repeating
MAX_COPIES = 3        # a target stops at this multiple of its source's size
FAN_IN = 64
LARGE = 3             # times its source's mean size
CHUNK = 1000         # equal rows, or copies of a row, that are dealt out together
BROADCAST_SOURCES = 50_000  # a source table up to this many rows is broadcast (checked)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target: the words of all sources shared by weight, no
    target above ``max_copies`` times its source, the excess shared again by weight.

    Sources sorted by cap / weight: those whose cap lies below the level left for the rest
    are capped, and the first that is not fixes the level. Works on one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place).withColumn(
        "weight", F.get(w, F.pmod(F.col("place") - 1, F.lit(len(weights)))))
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    per = per.withColumn("n", F.row_number().over(order)) \
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("heavy", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))) \
        .withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("heavy"))
    fixed = F.min_by(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")),
                     F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("n"))).over(everything)
    per = per.withColumn("fixed", fixed)
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("fixed") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def uniform(key: Column, *salt) -> Column:
    """Number in [0, 1) drawn from a key."""
    return F.shiftrightunsigned(F.xxhash64(key, *[F.lit(s) for s in salt]), 11).cast("double") / float(2 ** 53)


_ITEM = "struct<size:bigint,key:bigint,p:double,id:bigint,base:int,source:string,row:bigint>"


def _meet(level: int, seed: int):
    """Fold step: the residual ``a.r`` meets ``e``; one of them becomes integral."""
    none = F.lit(None).cast(_ITEM)

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["key"].alias("key"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), x["id"].alias("id"),
                        x["base"].alias("base"), x["source"].alias("source"), x["row"].alias("row"))

    def decided(x: Column, take: int) -> Column:
        return F.struct(x["row"].alias("row"), x["id"].alias("id"), x["size"].alias("size"),
                        x["source"].alias("source"), (x["base"] + take).alias("copies"))

    def step(a: Column, e: Column) -> Column:
        i, j = a["r"], e
        i_up, i_down = (1 - i["p"]) * i["size"], i["p"] * i["size"]
        j_up, j_down = (1 - j["p"]) * j["size"], j["p"] * j["size"]
        up, down = F.least(i_up, j_down), F.least(i_down, j_up)   # words that can move
        rises = uniform(j["key"], seed, level) * (up + down) < down
        i_ends = F.when(rises, i_up <= j_down).otherwise(i_down <= j_up)
        moved = F.when(rises, up).otherwise(-down)
        left = F.when(i_ends, with_p(j, j["p"] - moved / j["size"])).otherwise(with_p(i, i["p"] + moved / i["size"]))
        done = F.when(i_ends, F.when(rises, decided(i, 1)).otherwise(decided(i, 0))) \
            .otherwise(F.when(rises, decided(j, 0)).otherwise(decided(j, 1)))
        return F.when(i.isNull(), F.struct(e.alias("r"), a["out"].alias("out"))) \
            .otherwise(F.struct(left.alias("r"), F.concat(a["out"], F.array(done)).alias("out")))

    start = F.struct(none.alias("r"), F.array().cast(
        "array<struct<row:bigint,id:bigint,size:bigint,source:string,copies:int>>").alias("out"))
    return start, step


def _balance_large(d: DataFrame, seed: int) -> DataFrame:
    """``d`` (key, source, size, p, source_size, n_docs) with p of the large documents drawn to 0
    or 1, and p of the others moved so that each source's sum of p * size stays."""
    part = d.where("size > 0 AND p > 0")
    sizes = part.groupBy("source", "size").agg(
        F.sum("size").alias("words"), F.first("p").alias("p"), F.first("source_size").alias("all"),
        (F.first("source_size") / F.first("n_docs")).alias("mean"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    fits = F.sum("words").over(down) <= F.col("all") * F.least(F.col("p"), 1 - F.col("p"))
    cuts = sizes.withColumn("fits", fits).where(F.col("fits") & (F.col("size") > LARGE * F.col("mean"))) \
        .groupBy("source").agg(F.min("size").alias("cut"))
    cuts = cut(cuts.withColumnRenamed("source", "s"))  # one row per source
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    d = d.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    large = (F.col("size") >= F.col("cut")) & (F.col("p") > 0)
    drawn = F.when(uniform(F.col("key"), seed, "large") < F.col("p"), 1.0).otherwise(0.0)
    d = d.withColumn("large", F.coalesce(large, F.lit(False))).withColumn("drawn", drawn)
    moved = cut(d.where("cut IS NOT NULL").groupBy(F.col("source").alias("s")).agg(
        (F.sum(F.when(F.col("large"), (F.col("drawn") - F.col("p")) * F.col("size")).otherwise(0.0))
         / F.sum(F.when(F.col("large"), 0).otherwise(F.col("size")))).alias("by")))
    side = F.broadcast(moved) if moved.count() <= BROADCAST_SOURCES else moved
    d = d.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    other = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.coalesce("by", F.lit(0.0))))
    return d.withColumn("p", F.when(F.col("large"), F.col("drawn")).otherwise(other)) \
        .drop("cut", "large", "drawn", "by")


def _each_copy(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, source, size, equal rows repeated) with ``copy``, the number of the row
    among its equals. Equal rows are counted (with map-side combine) and dealt out again in
    chunks, so their number is no window and no task holds them all."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = rows.groupBy("key", "id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    single = same.where("m = 1").select("key", "id", "source", "size", F.lit(0).cast("bigint").alias("copy"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / CHUNK)))
    many = same.where("m > 1").withColumn("chunk", chunk).repartition(n, "key", "chunk")
    first = F.col("chunk") * CHUNK
    last = F.least(F.col("m"), first + CHUNK) - 1
    many = many.select("key", "id", "source", "size", F.explode(F.sequence(first, last)).alias("copy"))
    return single.unionByName(many)


def copies(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """key, id, size, source_size, target, copies for every row of ``sizes`` (key bigint,
    id bigint, source string, size bigint); rows that are equal in key are equal in all."""
    # read twice: word counts are made once; draws are by (key, copy), kept in ``key``
    sizes = stored(sizes, "mixing-sizes")
    sizes = stored(_each_copy(sizes).select(
        F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy")).alias("key"),
        F.col("key").alias("row"), "id", "source", "size"), "mixing-items")
    targets = cut(source_targets(sizes))
    n_sources, most = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    side = targets.withColumnRenamed("source", "s")
    if n_sources <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    d = sizes.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))) \
        .otherwise(F.lit(0.0))
    d = d.withColumn("base", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    d = d.withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(FAN_IN)).cast("bigint"))
    d = _balance_large(d, seed)
    plain = (F.col("size") == 0) | (F.col("p") <= 0) | (F.col("p") >= 1)
    free = d.where(plain).select(
        "row", "id", "size", "source",
        (F.col("base") + F.when(uniform(F.col("key"), seed) < F.col("p"), 1).otherwise(0)).alias("copies"))
    item = F.struct("size", "key", "p", "id", "base", "source", "row").alias("item")
    live = d.where(~plain).select("source", F.pmod(F.xxhash64("key"), F.col("buckets")).alias("bucket"), item)
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil((most or 1) / FAN_IN)), FAN_IN) - 1e-9))
    parts = [free]
    reserve = live.where("bucket = 0") if levels > 1 else None
    live = live.where("bucket > 0") if levels > 1 else live
    for level in range(levels):
        start, step = _meet(level, seed)
        if reserve is not None and level == levels - 1:
            live = live.unionByName(reserve)
        folded = cut(live.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
                     .select("source", "bucket", F.aggregate("items", start, step).alias("f"))
                     .select("source", "bucket", "f.r", "f.out"))
        parts.append(folded.select(F.explode("out").alias("o")).select("o.*")
                     .select("row", "id", "size", "source", "copies"))
        live = folded.select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), F.col("r").alias("item"))
    parts.append(live.select("item.*").select(
        "row", "id", "size", "source",
        (F.col("base") + F.when(uniform(F.col("key"), seed, "root") < F.col("p"), 1).otherwise(0)).alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(side.drop("n_docs"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s") \
        .withColumnRenamed("row", "key")


def document_sizes(docs: DataFrame) -> DataFrame:
    """key (identity of the row), id, source and size in words of every document."""
    return docs.select(identity(*DOCUMENT_COLUMNS)[0].alias("key"), F.col("doc_id").alias("id"), "source",
                       F.size(words_of(F.col("text"))).cast("bigint").alias("size"))


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix: each row as often as its copies say (0 to 3); the columns of
    ``documents``. Equal rows are one row here, taken as often as the copies of all say."""
    decided = copies(document_sizes(docs), seed).groupBy("key", "id").agg(F.sum("copies").alias("all")).where("all > 0") \
        .withColumnRenamed("key", "k")
    rows = docs.select(*DOCUMENT_COLUMNS, identity(*DOCUMENT_COLUMNS)[0].alias("key")) \
        .groupBy("key", "doc_id").agg(*[F.first(c).alias(c) for c in DOCUMENT_COLUMNS if c != "doc_id"])
    taken = rows.join(decided, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    few = taken.where(F.col("all") <= CHUNK).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("all"))))
    # a row of very many copies is dealt to tasks in chunks of them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all") - 1) / CHUNK)))
    many = taken.where(F.col("all") > CHUNK).withColumn("chunk", chunk).repartition(n, "key", "chunk")
    size = F.least(F.lit(CHUNK).cast("bigint"), F.col("all") - F.col("chunk") * CHUNK)
    many = many.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    return few.select(DOCUMENT_COLUMNS).unionByName(many.select(DOCUMENT_COLUMNS))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(document_sizes(table(spark, sf_dir, "documents")))
    return c.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies")
