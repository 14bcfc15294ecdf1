"""Missing data and replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.series import bfill, ffill, interpolate
from weftline.plans.sizing import one_row

__all__ = [
    "bfill", "dropna", "dropna_cols", "ffill", "fillna", "fillna_mean", "interpolate", "isnull",
    "nan_to_null", "notnull", "replace_values", "shift_cols",
]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null as the only missing marker: for use right after a scan."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c, t in df.dtypes if t in ("double", "float")})


def isnull(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).isNull() for c in columns})


def notnull(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).isNotNull() for c in columns})


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without missing cells (``any``), with some cell (``all``) or with ``thresh`` known cells."""
    return df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None)


def dropna_cols(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Columns without missing cells; one row of null counts decides."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return df.select(*key, *[c for c in columns if row[c] == 0])


def fillna(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill with one value or a mapping of column to value.

    A text value turns the columns it goes into to text, where the built-in
    fill would leave number columns as they are.
    """
    values: Mapping = value if isinstance(value, Mapping) else {c: value for c in (columns or df.columns)}
    kinds = dict(df.dtypes)
    out = {}
    for c, v in values.items():
        text = isinstance(v, str) and kinds[c] != "string"
        out[c] = F.coalesce(F.col(c).cast("string") if text else F.col(c), F.lit(v))
    return df.withColumns(out)


def fillna_mean(df: DataFrame, columns: Sequence[str], source: str | None = None) -> DataFrame:
    """Fill all columns with the mean of ``source``, or each with its own mean."""
    if source is not None:
        mean = one_row(df, {"m": F.avg(source)})["m"]
        return df.withColumns({c: F.coalesce(F.col(c), mean) for c in columns})
    means = one_row(df, {c: F.avg(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def replace_values(df: DataFrame, mapping: Mapping, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole-cell replacement."""
    return df.na.replace(dict(mapping), subset=list(columns) if columns else None)


def shift_cols(df: DataFrame, columns: Sequence[str], n: int = 1, kind: str = "double") -> DataFrame:
    """Cells move ``n`` columns to the right (left when negative); emptied columns are null."""
    others = [F.col(c) for c in df.columns if c not in columns]
    moved = []
    for i, c in enumerate(columns):
        at = i - n
        cell = F.col(columns[at]) if 0 <= at < len(columns) else F.lit(None)
        moved.append(cell.cast(kind).alias(c))
    return df.select(*others, *moved)
