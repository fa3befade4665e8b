"""Exact, interpolated quantiles as one lazy plan.

Spark's exact ``percentile`` merges a value -> count map of the whole column into the single
task of a global aggregate. Here only the neighbourhood of the wanted ranks is looked at:

1. one aggregate (``column_stats``: map-side partial, one row) gives the moments of every column and,
   from a sketch with rank error 1 / ``bins``, a bracket of values around each probability that
   is wider than that error on both sides, so the order statistics it needs lie inside; columns of
   few values get (min, max) as their bracket;
2. that one row is a scalar subquery of the second pass over the rows, which counts the rows below
   each bracket and the distinct values inside it (about 16 / ``bins`` of the rows) by one aggregate
   with map-side combine: a value with a third of the rows is one partial row per task;
3. the values of a bracket are cumulated in order from the count below, and the order statistics
   are picked and interpolated by one aggregate.

No step collects, no table is gathered in one task, and the plan is the same for any input.
The expressions are SQL text: built call by call, they took longer than the query's run at small
sizes. Interpolation is the linear rule of pandas ``describe`` / SQL ``percentile_cont``: position
p * (n - 1) between the two neighbouring order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

CI, V, N, P, T = "__ci", "__v", "__n", "__p", "__t"
BINS = 10_000
MARGIN = 8  # of a bracket, in sketch errors


def _clean(c: str) -> str:
    """The values that count: doubles without NaN (the other rows are NULL)."""
    x = f"cast(`{c.replace('`', '``')}` AS double)"
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def bracket_shares(probs: Sequence[float], bins: int) -> list[float]:
    """Both ends of the bracket around each of ``probs``."""
    slack = MARGIN / bins
    return [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]


def column_stats(df: DataFrame, cols: Sequence[str], shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """One row: a struct ``__m<i>`` per column with count, mean, std (n-1), min, max and ``sketched``,
    the approximate quantiles ``shares``."""
    at = f"array({', '.join(f'{x!r}D' for x in shares)})"
    of = lambda x: (f"struct(count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, "  # noqa: E731
                    f"max({x}) AS max, percentile_approx({x}, {at}, {bins}) AS sketched)")
    return df.agg(*[F.expr(of(_clean(c))).alias(f"__m{i}") for i, c in enumerate(cols)])


def quantiles_of(df: DataFrame, cols: Sequence[str], stats: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75),
                 bins: int = BINS) -> DataFrame:
    """(__ci, quantiles) as ``column_quantiles``, from the ``column_stats`` of the same rows
    at the ``bracket_shares``."""
    def bracket(i: int, j: int) -> str:
        # below 4 errors' worth of rows the sketch's bracket may be off by a rank: take all values
        few = f"__m{i}.count * {MARGIN / bins!r}D < 4"
        return (f"struct(if({few}, __m{i}.min, __m{i}.sketched[{2 * j}]) AS lo, "
                f"if({few}, __m{i}.max, __m{i}.sketched[{2 * j + 1}]) AS hi, __m{i}.count AS n)")

    def item(k: int, i: int, j: int) -> str:
        b, x = f"__k[{k}]", f"__x{i}"
        return (f"CASE WHEN {x} <= {b}.hi THEN struct({i} AS {CI}, {j} AS {P}, {b}.n AS {T}, "
                f"CASE WHEN {x} >= {b}.lo THEN {x} END AS {V}) END")

    places = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    known = stats.selectExpr(f"array({', '.join(bracket(i, j) for i, j in places)})").scalar()
    # behind a generator the subquery stands once in the plan, not at each use
    d = df.select(*[F.expr(_clean(c)).alias(f"__x{i}") for i, c in enumerate(cols)], F.explode(F.array(known)).alias("__k"))
    items = d.selectExpr(f"explode(array({', '.join(item(k, i, j) for k, (i, j) in enumerate(places))})) AS s")
    counts = items.where("s IS NOT NULL").select("s.*").groupBy(CI, P, T, V).agg(F.expr(f"count(1) AS {N}"))
    # the rows below (a NULL value) come first
    shares = f"array({', '.join(f'{float(p)!r}D' for p in probs)})"
    placed = counts.selectExpr(CI, P, V, N, f"sum({N}) OVER (PARTITION BY {CI}, {P} ORDER BY {V} NULLS FIRST) AS upto",
                               f"{shares}[{P}] * ({T} - 1) AS pos").where(f"{V} IS NOT NULL")
    at = lambda r: f"max(CASE WHEN {r}(pos) < upto AND {r}(pos) >= upto - {N} THEN {V} END)"
    ends = placed.groupBy(CI, P).agg(F.expr(f"{at('floor')} AS a"), F.expr(f"{at('ceil')} AS z"), F.expr("max(pos - floor(pos)) AS f"))
    return ends.groupBy(CI).agg(F.expr(
        f"transform(array_sort(collect_list(struct({P}, a + (z - a) * f AS q))), x -> x.q) AS quantiles"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
                     bins: int = BINS) -> DataFrame:
    """(__ci, quantiles): exact quantiles ``probs`` of each column (by position in ``cols``);
    NULL and NaN are skipped, a column without values has no row."""
    return quantiles_of(df, cols, column_stats(df, cols, bracket_shares(probs, bins), bins), probs, bins)
