"""Row filters, cell masks and choices."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, *conditions: Column, any_of: bool = False) -> DataFrame:
    """Rows for which all (or any) conditions hold; an unknown condition does not hold."""
    joined = reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), conditions)
    return df.filter(joined)


def filter_cols_by_stat(
    df: DataFrame,
    columns: Sequence[str],
    stat: Callable[[Column], Column],
    keep: Callable[[float], bool],
    key: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Columns whose statistic passes ``keep``; one aggregate job of one row decides."""
    row = df.agg(*[stat(F.col(c)).alias(c) for c in columns]).first()
    kept = [c for c in columns if row[c] is not None and keep(row[c])]
    out = df.filter(where) if where is not None else df
    return out.select(*key, *kept)


def mask_cells(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Cells whose condition does not hold turn null."""
    return df.withColumns({c: F.when(cond, F.col(c)) for c, cond in conditions.items()})


def isin_cells(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    """True where a cell is one of ``values``; a missing cell is not.  Text is only compared with text."""
    kinds = dict(df.dtypes)

    def fits(c):
        text = kinds[c] == "string"
        return [v for v in values if isinstance(v, str) == text]

    return df.withColumns(
        {c: F.coalesce(F.col(c).isin(fits(c)), F.lit(False)) if fits(c) else F.lit(False) for c in columns}
    )


def where_else(cond: Column, value: Column, other) -> Column:
    """``value`` where the condition holds, else ``other`` (also where it is unknown)."""
    return F.when(cond, value).otherwise(other)


def clip(c: Column, lower=None, upper=None) -> Column:
    """Keep within bounds; a missing value stays missing."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def all_any(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row: ``<name>_all`` and ``<name>_any`` per test, and ``any_any`` over all of them."""
    known = {n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}
    out = df.agg(
        *[F.bool_and(t).alias(f"{n}_all") for n, t in known.items()],
        *[F.bool_or(t).alias(f"{n}_any") for n, t in known.items()],
    )
    anys = [F.col(f"{n}_any") for n in tests]
    return out.withColumn("any_any", reduce(lambda a, b: a | b, anys))


def enough_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the keys that have at least ``n`` rows."""
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n)
    return df.join(big, key, "left_semi")
