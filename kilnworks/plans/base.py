"""The registry of queries, and what many of them start from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.operators import series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The hourly process frame in DuckDB SQL: h, the five columns and rn.
P = """e AS (SELECT CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS h, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
g AS (SELECT unnest(range(min(h), max(h) + 1)) AS h FROM e),
P AS (SELECT g.h, row_number() OVER (ORDER BY g.h) - 1 AS rn, max(CASE WHEN event_type = 'view' THEN v END) AS view, max(CASE WHEN event_type = 'click' THEN v END) AS click,
  max(CASE WHEN event_type = 'error' THEN v END) AS error, max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase, max(CASE WHEN event_type = 'signup' THEN v END) AS signup
  FROM g LEFT JOIN e ON g.h = e.h GROUP BY g.h)"""

#: Inputs filled forward by at most six rows.
FILLED = P + """,
Q AS (SELECT h, rn, error, purchase, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in series.INPUTS) + """ FROM P WINDOW w AS (ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly process frame of the events."""
    return series.resample_mean(table(spark, sf_dir, "events"))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.forward_fill(frame(spark, sf_dir), series.INPUTS)


def r6(*columns: str) -> list[Column]:
    """The columns rounded to six places, under their own names."""
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def sql_r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def corr_sql(x: str, y: str) -> str:
    """Pearson correlation that is null where a side is constant."""
    return f"(covar_pop({x}, {y}) / nullif(sqrt(var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END)), 0))"


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """variable and value, a row for each of the columns."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in columns], "variable", "value")


def long_sql(source: str, columns: Sequence[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}{',' if keep else ''} '{c}' AS variable, {c} AS value FROM {source}" for c in columns)
