"""Sorting, top rows, samples and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_values(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sorted rows, missing values last in both directions."""
    ups = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in zip(by, ups, strict=True)])


def sort_index(df: DataFrame, key: Sequence[str], ascending: bool = True) -> DataFrame:
    return sort_values(df, key, ascending)


def sort_columns(df: DataFrame, key: Sequence[str], ascending: bool = True) -> DataFrame:
    names = sorted([c for c in df.columns if c not in key], reverse=not ascending)
    return df.select(*key, *names)


def topk(df: DataFrame, by: str, k: int, key: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) value; ``key`` settles ties."""
    first = F.desc_nulls_last(by) if largest else F.asc_nulls_last(by)
    return df.orderBy(first, *[F.asc_nulls_last(c) for c in key]).limit(k)


def sample_rows(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly ``n`` random rows (all rows when there are fewer): the first by a hash of seed and key, whatever the files."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.withColumn("__r", F.md5(text)).orderBy("__r", *keys).limit(n).drop("__r")


def _kept(df: DataFrame, columns: Sequence[str], order: str, keep: str) -> DataFrame:
    """The order value of the row that stays, per group of equal rows."""
    pick = {"first": F.min, "last": F.max}[keep]
    return df.groupBy(*columns).agg(pick(order).alias(order))


def duplicated(df: DataFrame, columns: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """Flags rows equal to an earlier one (later one for ``keep='last'``); missing equals missing.

    Equal rows are combined before the shuffle and met again on the unique
    order column, so a row that makes up a third of the table is no hot spot.
    """
    kept = _kept(df, columns, order, keep).select(order, F.lit(False).alias("__dup"))
    joined = df.join(kept, order, "left")
    return joined.withColumn("duplicated", F.coalesce("__dup", F.lit(True))).drop("__dup")


def drop_duplicates(df: DataFrame, columns: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """One row of each group of equal rows: the first or the last in order."""
    others = [c for c in df.columns if c not in columns and c != order]
    if not others:
        return _kept(df, columns, order, keep).select(*df.columns)
    return df.join(_kept(df, columns, order, keep).select(order), order, "left_semi")
