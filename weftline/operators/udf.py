"""User functions over tables: pipes, cell maps, transforms, row functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnFn = Callable[[Column], Column]


def pipe(df: DataFrame, *steps) -> DataFrame:
    """Chain of ``fn`` or ``(fn, arg, …)`` steps, each DataFrame to DataFrame."""
    for step in steps:
        fn, *args = step if isinstance(step, tuple) else (step,)
        df = df.transform(fn, *args)
    return df


def map_cells(df: DataFrame, columns: Sequence[str], fn: ColumnFn) -> DataFrame:
    """A column expression on every cell; stays in the JVM."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def map_cells_python(df: DataFrame, columns: Sequence[str], fn: Callable, kind: str) -> DataFrame:
    """A Python function of one value on every cell, in Arrow batches; null stays null.

    For functions that have no column form only.
    """

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return map_cells(df, columns, run)


def transform(df: DataFrame, key: Sequence[str], fns: ColumnFn | Mapping[str, ColumnFn] | Sequence[tuple[str, ColumnFn]], columns: Sequence[str]) -> DataFrame:
    """Same rows, new cells: one function, one per column, or a named list (``A_sqrt``, ``A_double``).

    Functions that aggregate are refused: the result must keep its shape.
    """
    if callable(fns):
        out = {c: fns(F.col(c)) for c in columns}
    elif isinstance(fns, Mapping):
        out = {c: f(F.col(c)) for c, f in fns.items()}
    else:
        out = {f"{c}_{n}": f(F.col(c)) for c in columns for n, f in fns}
    # an aggregate next to a plain column does not analyse, so a function that
    # changes the shape is caught before anything runs
    row = F.col(df.columns[0]).alias("__row")
    return df.select(*key, row, *[e.alias(n) for n, e in out.items()]).drop("__row")


def map_rows(df: DataFrame, fn: Callable[[dict[str, Column]], Column], columns: Sequence[str], out: str) -> DataFrame:
    """A function of the row's columns, as an expression."""
    return df.withColumn(out, fn({c: F.col(c) for c in columns}))


def map_rows_python(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str], out: str, kind: str) -> DataFrame:
    """A vectorised Python function of the row's columns, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)

    return df.withColumn(out, run(F.struct(*columns)))
