"""Registration of queries and the pieces they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.maths import signed_zero
from weftline.plans.ordered import Line
from weftline.plans.sizing import written
from weftline.sources import bars as bar_source

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6

def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str, **how: str) -> DataFrame:
    return bar_source.bars(table(spark, sf, "events"), **how)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return bar_source.bars_grid(bars(spark, sf))


def bars_once(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as a written table: the size check of a line and its use share one reading of the events."""
    return written(bars(spark, sf), "bars")


def bar_line(spark: SparkSession, sf: str) -> Line:
    return Line.of(bars_once(spark, sf), "ticker", "bar_ts")


def split_line(spark: SparkSession, sf: str) -> Line:
    """Bars in blocks of 300 rows: the plan of a key that fits no task, with the rows of the other plan."""
    return Line.of(bars_once(spark, sf), "ticker", "bar_ts", limit=300)


def grid_line(spark: SparkSession, sf: str) -> Line:
    return Line.of(grid(spark, sf), "ticker", "bar_ts")


def rounded(df: DataFrame, digits: int = DIGITS, columns: list[str] | None = None) -> DataFrame:
    """Doubles rounded for comparison."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: signed_zero(F.col(c), digits) for c in names})


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL of a rounded column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def rs(columns: Mapping[str, str] | list[str] | tuple[str, ...], digits: int = DIGITS) -> str:
    if not isinstance(columns, Mapping):
        columns = {c: c for c in columns}
    return ", ".join(r(e, n, digits) for n, e in columns.items())


BARS = """
bars AS (
  SELECT event_type AS ticker, date_trunc('hour', ts) AS bar_ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(CAST(props->>'$.k' AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2
)"""

# bars with their row number (from 0) per ticker
NUMBERED = BARS + """,
b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS i FROM bars)"""

GRID = BARS + """,
span AS (SELECT date_trunc('day', min(bar_ts)) AS lo, date_trunc('day', max(bar_ts)) + INTERVAL 23 HOUR AS hi FROM bars),
grid AS (
  SELECT k.ticker, k.bar_ts, open, high, low, close, volume
  FROM (SELECT t.ticker, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bar_ts
        FROM (SELECT DISTINCT ticker FROM bars) t, span) k
  LEFT JOIN bars USING (ticker, bar_ts)
),
g AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS i FROM grid)"""

OVER = "OVER (PARTITION BY ticker ORDER BY bar_ts)"


def last_rows(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guarded(agg: str, column: str, n: int) -> str:
    """Rolling aggregate that is null until ``n`` values are known."""
    w = last_rows(n)
    return f"CASE WHEN count({column}) {w} = {n} THEN {agg}({column}) {w} END"
