"""SQL text for the oracle side (DuckDB / ANSI), over a relation ``v``.

Rules shared with the Spark side: NULL keys and times are dropped before
grouping, counts are BIGINT, float summaries are rounded to ``DIGITS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.rounding import DIGITS, report_round_sql as rnd  # noqa: F401
HOUR = "date_trunc('hour', ts)"


def sql_list(values) -> str:
    """A SQL IN-list of literals."""
    return "(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _where(*conds: str | None) -> str:
    cs = [c for c in conds if c]
    return (" WHERE " + " AND ".join(f"({c})" for c in cs)) if cs else ""


def value_counts(cols: str | Sequence[str], dropna: bool = True, k: int | None = None,
                 where: str | None = None, name: str = "count") -> str:
    cs = [cols] if isinstance(cols, str) else list(cols)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cs) if dropna else None
    s = (f"SELECT {', '.join(cs)}, count(*) AS {name} FROM v{_where(where, nn)} "
         f"GROUP BY {', '.join(cs)}")
    if k is not None:
        s += (f" ORDER BY {name} DESC, " + ", ".join(f"{c} ASC NULLS FIRST" for c in cs)
              + f" LIMIT {k}")
    return s


def count_where(pred: str, name: str = "count") -> str:
    return f"SELECT count(*) FILTER (WHERE {pred}) AS {name} FROM v"


def shape(n_columns: int, columns: Sequence[str] | None = None) -> str:
    extra = f", '{','.join(columns)}' AS columns" if columns else ""
    return f"SELECT count(*) AS n_rows, {n_columns} AS n_columns{extra} FROM v"


def sample(columns: Sequence[str], n: int = 5) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in columns)
    return f"SELECT * FROM v ORDER BY {order} LIMIT {n}"


def detail(select: str, where: str) -> str:
    return f"SELECT {select} FROM v WHERE {where}"


def hourly(key: str, agg: str, where: str | None = None) -> str:
    return (f"SELECT {key}, {HOUR} AS hour, {agg} FROM v"
            f"{_where(where, f'{key} IS NOT NULL', 'ts IS NOT NULL')} GROUP BY 1, 2")


def count_hourly(key: str, where: str | None = None, name: str = "count") -> str:
    return hourly(key, f"count(*) AS {name}", where)


def share_hourly(key: str, pred: str, name: str) -> str:
    return hourly(key, f"count(*) FILTER (WHERE {pred}) / count(*) AS {name}")


def describe(cols: Sequence[str], source: str = "v", where: str | None = None) -> str:
    def one(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        r = rnd
        return (f"SELECT '{c}' AS column_name, count({x}) AS count, {r(f'avg({x})')} AS mean, "
                f"{r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS min, "
                f"{r(f'quantile_cont({x}, 0.25)')} AS q25, {r(f'quantile_cont({x}, 0.5)')} AS q50, "
                f"{r(f'quantile_cont({x}, 0.75)')} AS q75, {r(f'max({x})')} AS max "
                f"FROM {source}{_where(where)}")
    return " UNION ALL ".join(one(c) for c in cols)


def hourly_dense(where: str | None = None, name: str = "count") -> str:
    return (
        "WITH c AS (SELECT " + HOUR + f" AS hour, count(*) AS {name} FROM v"
        + _where(where, "ts IS NOT NULL") + " GROUP BY 1), "
        "s AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour "
        "FROM c HAVING min(hour) IS NOT NULL) "
        f"SELECT s.hour AS hour, coalesce(c.{name}, 0) AS {name} FROM s LEFT JOIN c ON s.hour = c.hour"
    )
