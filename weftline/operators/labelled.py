"""Labels: which columns are row labels, and alignment of tables on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe, left_join, outer_join, without_partner
from weftline.plans.sizing import one_row


@dataclass(frozen=True)
class Labelled:
    """A DataFrame with its label columns and, where order matters, its order columns.

    Changing roles starts no job.
    """

    df: DataFrame
    key_cols: tuple[str, ...] = ()
    order_cols: tuple[str, ...] = ()

    def set_index(self, *cols: str) -> Labelled:
        return replace(self, key_cols=cols)

    def reset_index(self, names: dict[str, str] | None = None) -> Labelled:
        """Labels become plain columns again, renamed if asked."""
        return replace(self, df=self.df.withColumnsRenamed(names or {}), key_cols=())

    def droplevel(self, level: int) -> Labelled:
        gone = self.key_cols[level]
        kept = tuple(k for k in self.key_cols if k != gone)
        return replace(self, df=self.df.drop(gone), key_cols=kept)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key_cols]

    def frame(self) -> DataFrame:
        """Label columns first."""
        return self.df.select(*self.key_cols, *self.values)


def label_list(df: DataFrame, key: str, labels: Sequence) -> DataFrame:
    """Labels as rows in the type of ``key``, with their place in the list."""
    spark = df.sparkSession
    kind = df.schema[key].dataType
    rows = spark.createDataFrame([(list(labels),)], f"`l` array<{kind.simpleString()}>")
    return rows.select(F.posexplode("l").alias("label_order", key))


# -- reindex -------------------------------------------------------------------


def reindex_rows(df: DataFrame, key: str, labels: Sequence | DataFrame, fill=None) -> DataFrame:
    """One row per asked label, in list order (``label_order``); an absent label is null or ``fill``."""
    wanted = labels if isinstance(labels, DataFrame) else label_list(df, key, labels)
    out = left_join(wanted, df.withColumn("__here", F.lit(True)), key)
    if fill is not None:
        cells = [c for c in df.columns if c != key]
        absent = F.col("__here").isNull()
        out = out.withColumns({c: F.when(absent, F.lit(fill)).otherwise(F.col(c)) for c in cells})
    return out.drop("__here")


def reindex_cols(df: DataFrame, columns: Sequence[str], fill=None, kind: str = "double") -> DataFrame:
    """Exactly the asked columns; an absent one is null or ``fill``."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(fill).cast(kind).alias(c) for c in columns]
    )


def reindex_like(df: DataFrame, key: str, other: DataFrame, fill=None) -> DataFrame:
    """Rows and columns of ``other``, cells of ``df``."""
    rows = reindex_rows(df, key, other.select(key), fill)
    return reindex_cols(rows, other.columns, fill)


# -- alignment -----------------------------------------------------------------


def align(left: DataFrame, right: DataFrame, key: str, join: str = "outer") -> tuple[DataFrame, DataFrame]:
    """Both tables with the same labels and the same columns (sorted)."""
    pair, columns = _side_by_side(left, right, key, join)
    return tuple(
        pair.select(key, *[F.col(f"__{side}_{c}").alias(c) for c in columns]) for side in ("l", "r")
    )


def align_long(left: DataFrame, right: DataFrame, key: str, join: str = "outer") -> DataFrame:
    """Both aligned tables under each other, named in ``side``: one join for the two."""
    pair, columns = _side_by_side(left, right, key, join)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("side"), *[F.col(f"__{tag}_{c}").alias(c) for c in columns])
            for name, tag in (("left", "l"), ("right", "r"))
        ]
    )
    return pair.select(key, F.inline(rows)).select("side", key, *columns)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _side_by_side(left: DataFrame, right: DataFrame, key: str | Sequence[str], join: str) -> tuple[DataFrame, list[str]]:
    """One row per label pair with the cells of both tables; absent columns are null."""
    keys = _keys(key)
    mine = [c for c in left.columns if c not in keys]
    theirs = [c for c in right.columns if c not in keys]
    if join == "outer":
        columns = sorted({*mine, *theirs})
    elif join == "inner":
        columns = [c for c in sorted(mine) if c in theirs]
    else:
        raise ValueError("join is 'outer' or 'inner'")
    types = dict(right.dtypes) | dict(left.dtypes)

    def side(df, names, tag):
        cells = [
            (F.col(c) if c in names else F.lit(None).cast(types[c])).alias(f"__{tag}_{c}") for c in columns
        ]
        return df.select(*keys, *cells)

    both = side(left, mine, "l"), side(right, theirs, "r")
    return (outer_join(*both, key) if join == "outer" else join_null_safe(*both, keys, "inner")), columns


# Operators by name.
ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": F.try_divide,
}
COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "gt": lambda a, b: a > b,
    "le": lambda a, b: a <= b,
    "ge": lambda a, b: a >= b,
}


def _operation(op: str) -> Callable[[Column, Column], Column]:
    """Arithmetic by name; a leading ``r`` swaps the two sides."""
    if op in ARITHMETIC:
        return ARITHMETIC[op]
    swapped = ARITHMETIC[op.removeprefix("r")]
    return lambda a, b: swapped(b, a)


def binary(left: DataFrame, other: DataFrame | dict | int | float, op: str, key: str, axis: str = "frame", fill=None) -> DataFrame:
    """``left op other`` cell by cell.

    ``other`` is a frame with labels (``axis='frame'``), a one-value-per-row
    series ``(key, value)`` (``axis='rows'``), a mapping of column to value
    (``axis='columns'``) or a number.  Labels and columns are united; a cell
    that only one side has is null.  ``fill`` stands in for a missing cell when
    the other side is known.  Division by zero is null.
    """
    fn = _operation(op)
    if isinstance(other, (int, float)):
        return left.select(key, *[fn(F.col(c), F.lit(other)).alias(c) for c in left.columns if c != key])
    if axis == "columns":
        return arith_row_series(left, other, op, key)
    if axis == "rows":
        return arith_col_series(left, other, op, key)
    pair, columns = _side_by_side(left, other, key, "outer")
    return pair.select(key, *[_cell(fn, c, fill).alias(c) for c in columns])


def _cell(fn: Callable[[Column, Column], Column], c: str, fill) -> Column:
    a, b = F.col(f"__l_{c}"), F.col(f"__r_{c}")
    if fill is None:
        return fn(a, b)
    known = a.isNotNull() | b.isNotNull()
    return F.when(known, fn(F.coalesce(a, F.lit(fill)), F.coalesce(b, F.lit(fill))))


def binary_many(left: DataFrame, other: DataFrame, wanted: Sequence[tuple[str, str, object]], key: str) -> DataFrame:
    """Several operations ``(column, op, fill)`` from one join, as ``<column>_<op>``."""
    pair, _ = _side_by_side(left, other, key, "outer")
    return pair.select(key, *[_cell(_operation(op), c, fill).alias(f"{c}_{op}") for c, op, fill in wanted])


def arith_row_series(df: DataFrame, row: dict[str, Column | int | float], op: str, key: str) -> DataFrame:
    """Every row against one row of values; a column that one side lacks is null.

    Values may be aggregate columns of ``df`` (``F.avg("a")``): they become
    one-row scalar subqueries.
    """
    fn = _operation(op)
    cells = [c for c in df.columns if c != key]
    asked = {c: v for c, v in row.items() if isinstance(v, Column)}
    values = {**{c: F.lit(v) for c, v in row.items() if c not in asked}, **one_row(df, asked)}
    out = []
    for c in sorted({*cells, *row}):
        both = c in cells and c in values
        out.append((fn(F.col(c), values[c]) if both else F.lit(None).cast("double")).alias(c))
    return df.select(key, *out)


def arith_col_series(df: DataFrame, series: DataFrame, op: str, key: str, value: str = "value") -> DataFrame:
    """Every column against a series with the same labels; labels are united."""
    fn = _operation(op)
    cells = [c for c in df.columns if c != key]
    joined = outer_join(df, series.select(key, F.col(value).alias("__v")), key)
    return joined.select(key, *[fn(F.col(c), F.col("__v")).alias(c) for c in cells])


def arith_own_column(df: DataFrame, column: str, op: str, key: str) -> DataFrame:
    """Every column against one column of the same table: no join."""
    fn = _operation(op)
    return df.select(key, *[fn(F.col(c), F.col(column)).alias(c) for c in df.columns if c != key])


def compare(left: DataFrame, right: DataFrame, op: str, key: str | Sequence[str]) -> DataFrame:
    """Flexible comparison: labels and columns are united; a missing cell is false (true for ``ne``)."""
    fn = COMPARISON[op]
    pair, columns = _side_by_side(left, right, key, "outer")
    absent = F.lit(op == "ne")
    cells = [F.coalesce(fn(F.col(f"__l_{c}"), F.col(f"__r_{c}")), absent).alias(c) for c in columns]
    return pair.select(*_keys(key), *cells)


def compare_same(left: DataFrame, right: DataFrame, op: str, key: str | Sequence[str]) -> DataFrame:
    """Operator form: refuses tables whose labels or columns differ."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("tables have different columns")
    for a, b in ((left, right), (right, left)):
        if not without_partner(a.select(*_keys(key)), b, _keys(key)).isEmpty():
            raise ValueError("tables have different labels")
    return compare(left, right, op, key)


def compare_col_series(df: DataFrame, series: DataFrame, op: str, key: str | Sequence[str], value: str = "value") -> DataFrame:
    """Every column against a series with the same labels; a missing side is false (true for ``ne``)."""
    fn, absent = COMPARISON[op], F.lit(op == "ne")
    cells = [c for c in df.columns if c not in _keys(key)]
    joined = outer_join(df, series.select(*_keys(key), F.col(value).alias("__v")), key)
    return joined.select(*_keys(key), *[F.coalesce(fn(F.col(c), F.col("__v")), absent).alias(c) for c in cells])


def mask_compare(left: DataFrame, right: DataFrame, op: str, key: str | Sequence[str]) -> DataFrame:
    """Cells of ``left`` where the comparison holds; the others are null."""
    fn = COMPARISON[op]
    pair, columns = _side_by_side(left, right, key, "outer")
    mine = [c for c in left.columns if c not in _keys(key)]
    keep = [F.when(fn(F.col(f"__l_{c}"), F.col(f"__r_{c}")), F.col(f"__l_{c}")).alias(c) for c in columns if c in mine]
    return pair.select(*_keys(key), *keep)
