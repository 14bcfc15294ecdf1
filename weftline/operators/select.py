"""Selection and editing of rows and columns by label, position and type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.labelled import label_list
from weftline.plans.joining import left_join
from weftline.plans.ordered import Line
from weftline.plans.sizing import rows_per_task

# -- columns ----------------------------------------------------------------


def col_slice(df: DataFrame, first: str, last: str) -> DataFrame:
    """Columns from ``first`` to ``last``, both kept."""
    names = df.columns
    return df.select(*names[names.index(first) : names.index(last) + 1])


def col_positions(df: DataFrame, at: slice | Sequence[int]) -> DataFrame:
    """Columns by position: a slice (end left out) or a list."""
    names = df.columns
    return df.select(*(names[at] if isinstance(at, slice) else [names[i] for i in at]))


# Type families by Spark type name.
FAMILIES = {
    "bool": {"boolean"},
    "int": {"tinyint", "smallint", "int", "bigint"},
    "int32": {"int"},
    "int64": {"bigint"},
    "float": {"float", "double"},
    "float64": {"double"},
    "number": {"tinyint", "smallint", "int", "bigint", "float", "double"},
    "object": {"string"},
    "datetime": {"date", "timestamp", "timestamp_ntz"},
}


def select_dtypes(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Columns by type family; a plain Spark type name is a family of its own."""

    def types(families):
        return set().union(*[FAMILIES.get(f, {f}) for f in families])

    wanted, banned = types(include), types(exclude)
    keep = [n for n, t in df.dtypes if (not include or t in wanted) and t not in banned]
    return df.select(*keep)


def insert_col(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    names = [F.col(c) for c in df.columns]
    return df.select(*names[:at], value.alias(name), *names[at:])


def pop_col(df: DataFrame, key: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The table without the column, and the column as a series under its keys."""
    return df.drop(name), df.select(*key, name)


def assign_series(df: DataFrame, key: str, series: DataFrame, name: str, value: str) -> DataFrame:
    """New column from a (key, value) series; labels it lacks are null."""
    side = series.select(F.col(key), F.col(value).alias(name))
    return left_join(df.drop(name), side, key)


def rename_all(df: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[fn(c) for c in df.columns])


def flatten_columns(names: Sequence[str | tuple[str, ...]], level: int = 0) -> list[str]:
    """Plain names from tuple names by keeping one level."""
    return [n if isinstance(n, str) else n[level] for n in names]


def pick_level(df: DataFrame, key: Sequence[str], high: str, sep: str = "_") -> DataFrame:
    """Columns ``high_low`` of one high level, named by their low level."""
    head = high + sep
    return df.select(*key, *[F.col(c).alias(c[len(head) :]) for c in df.columns if c.startswith(head)])


def pick_low_level(df: DataFrame, key: Sequence[str], low: str, sep: str = "_") -> DataFrame:
    """Columns ``high_low`` of one low level, named by their high level."""
    tail = sep + low
    return df.select(*key, *[F.col(c).alias(c[: -len(tail)]) for c in df.columns if c.endswith(tail)])


def cast_cols(df: DataFrame, types: dict[str, str], errors: str = "raise") -> DataFrame:
    """Casts; with ``errors='null'`` a value that does not fit is null."""
    return df.withColumns(
        {c: F.col(c).try_cast(t) if errors == "null" else F.col(c).cast(t) for c, t in types.items()}
    )


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types with the rows of the table and the known cells of each column, from one aggregate."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    known = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = known.unpivot(["n_rows"], df.columns, "col_name", "known_cells")
    return long.select("col_name", kinds[F.col("col_name")].alias("data_type"), "n_rows", "known_cells")


# -- rows by label -----------------------------------------------------------


def label_rows(df: DataFrame, key: str, labels: Sequence) -> DataFrame:
    """All rows with the given labels; repeated labels give all their rows.

    A list keeps its own order through the column ``label_order``.
    """
    if len(labels) == 1:
        return df.filter(F.col(key) == labels[0]).withColumn("label_order", F.lit(0))
    wanted = label_list(df, key, labels)
    return wanted.join(df, key)


def label_slice(df: DataFrame, key: str, first, last, order: Sequence[str] | None = None) -> DataFrame:
    """Rows from label ``first`` to label ``last``, both kept.

    By label value; with ``order`` by the rows that stand between them.
    """
    if order is None:
        return df.filter(F.col(key).between(first, last))
    # the order values of the two labels bound the slice: no positions needed
    at = F.struct(*order)
    lo = df.filter(F.col(key) == first).agg(F.min(at)).scalar()
    hi = df.filter(F.col(key) == last).agg(F.max(at)).scalar()
    return df.filter((at >= lo) & (at <= hi))


# -- rows by position --------------------------------------------------------


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows in their order."""
    last = df.orderBy(*[F.desc_nulls_first(c) for c in order]).limit(n)
    return last.orderBy(*[F.asc_nulls_last(c) for c in order])


def pos_slice(df: DataFrame, order: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows ``start`` up to but not including ``stop``; negative numbers count from the end.

    A short slice near the top is an ordered limit.  Others use exact positions
    (one task only while the table fits it).
    """
    start = 0 if start is None else start
    if 0 <= start and stop is not None and 0 <= stop <= rows_per_task(df.sparkSession):
        ordered = df.orderBy(*[F.asc_nulls_last(c) for c in order])
        return ordered.offset(start).limit(max(stop - start, 0))
    line = Line.of(df, (), tuple(order)).with_position("__at").whole({"__n": F.count(F.lit(1))})

    def bound(i: int) -> Column:
        return F.lit(i) if i >= 0 else F.greatest(F.col("__n") + i, F.lit(0))

    out = line.result().filter(F.col("__at") >= bound(start))
    if stop is not None:
        out = out.filter(F.col("__at") < bound(stop))
    return out.drop("__at", "__n")


def pos_rows(df: DataFrame, order: Sequence[str], at: Sequence[int]) -> DataFrame:
    """Rows at the given positions (not negative)."""
    line = Line.of(df, (), tuple(order)).with_position("__at")
    return line.result().filter(F.col("__at").isin([int(i) for i in at])).drop("__at")


# -- editing rows ------------------------------------------------------------


def row_upsert(df: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Put rows in place of those with the same label, or add them; columns match by name."""
    kept = df.join(rows.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def row_patch(df: DataFrame, key: str, label, values: dict[str, object]) -> DataFrame:
    """Set cells of the rows with one label."""
    hit = F.col(key).eqNullSafe(F.lit(label))
    return df.withColumns(
        {c: F.when(hit, F.lit(v) if not isinstance(v, Column) else v).otherwise(F.col(c)) for c, v in values.items()}
    )


def row_copy(df: DataFrame, key: str, source, target) -> DataFrame:
    """Overwrite the cells of row ``target`` with those of row ``source`` (a label that occurs once)."""
    cells = [c for c in df.columns if c != key]
    row = df.filter(F.col(key) == source)
    return row_patch(df, key, target, {c: row.select(c).scalar() for c in cells})


def drop_rows(df: DataFrame, key: str, labels: Sequence) -> DataFrame:
    """Leave out the rows with the given labels; rows without a label stay."""
    return df.filter(~F.coalesce(F.col(key).isin(list(labels)), F.lit(False)))

