"""Column and row statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe
from weftline.plans.quantile import quantiles
from weftline.plans.sizing import GroupSizes, one_row

STATS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "range": lambda c: F.max(c) - F.min(c),
}


def summary_sql(df: DataFrame, view: str, query: str) -> DataFrame:
    """SQL over a table under a view name."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)


def date_range(df: DataFrame, ts: str, order: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Date of the first and of the last row in row order; nulls for an empty table."""
    at = F.struct(*order)
    return df.groupBy(*key).agg(
        F.to_date(F.min_by(ts, at)).alias("first_date"), F.to_date(F.max_by(ts, at)).alias("last_date")
    )


def agg_map(df: DataFrame, stats: Mapping[str, str]) -> DataFrame:
    """One row: one statistic per column."""
    return df.agg(*[STATS[s](F.col(c)).alias(c) for c, s in stats.items()])


def agg_list(df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row per statistic, one column per column; a single pass over the data."""
    wide = df.agg(*[STATS[s](F.col(c)).cast("double").alias(f"{s}|{c}") for s in stats for c in columns])
    rows = F.array(
        *[F.struct(F.lit(s).alias("stat"), *[F.col(f"{s}|{c}").alias(c) for c in columns]) for s in stats]
    )
    return wide.select(F.inline(rows))


def apply_cols(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """One aggregate per column."""
    return df.agg(*[fn(F.col(c)).alias(c) for c in columns])


def apply_all(df: DataFrame, columns: Sequence[str], out: str = "value") -> DataFrame:
    """Greatest value of all columns."""
    return apply_cols(df, columns, F.max).select(F.greatest(*columns).alias(out))


def row_sum(columns: Sequence[str]) -> Column:
    """Sum of the known cells of a row; 0 when none is known."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def row_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def row_mean(columns: Sequence[str]) -> Column:
    return F.try_divide(row_sum(columns), row_count(columns))


def row_range(columns: Sequence[str]) -> Column:
    return F.greatest(*columns) - F.least(*columns)


def mean_axis(df: DataFrame, columns: Sequence[str], skipna: bool = True) -> DataFrame:
    """Column means; without ``skipna`` a column with a missing cell has no mean."""

    def mean(c: Column) -> Column:
        return F.avg(c) if skipna else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    return apply_cols(df, columns, mean)


def _long(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """(keys, column, value) rows; a generator, not a shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*key, F.inline(cells))


# The quartiles of a description.
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max: one row per column."""
    cells = []
    for c in columns:
        v = F.col(c).cast("double")
        made = {"count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
        cells.append(F.struct(F.lit(c).alias("column"), *[x.alias(n) for n, x in made.items()]))
    basic = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    rows = df.count()
    sizes = GroupSizes(rows * len(columns), len(columns), rows)
    return basic.join(quantiles(_long(df, columns), ["column"], "value", QUARTILES, sizes=sizes), "column")


def describe_object(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct, most frequent value and its count; of equally frequent values the smallest."""
    counted = _long(df, columns, kind="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    counted = counted.filter(known)
    best = counted.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("value").alias("unique"), F.max("n").alias("freq")
    )
    top = (
        counted.join(best.select("column", F.col("freq").alias("n")), ["column", "n"])
        .groupBy("column")
        .agg(F.min("value").alias("top"))
    )
    return best.join(top, "column").select("column", "count", "unique", "top", "freq")


def standardize(df: DataFrame, columns: Sequence[str], ddof: int = 1, fit_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std`` with the statistics of ``fit_on`` (this table by default).

    ``ddof`` 1 is the sample deviation, 0 the population one.  A constant
    column gives null.
    """
    source = df if fit_on is None else fit_on
    dev = F.stddev_samp if ddof == 1 else F.stddev_pop
    stat = source.agg(
        F.struct(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), dev(c).alias(f"s_{c}"))]).alias("s")
    ).scalar()
    return df.withColumns({c: F.try_divide(F.col(c) - stat[f"m_{c}"], stat[f"s_{c}"]) for c in columns})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), F.asc(column)
    )


def share_of_total(df: DataFrame, column: str, out: str = "percent") -> DataFrame:
    """Percent of the column total per row (a pie's labels)."""
    total = one_row(df, {"t": F.sum(column)})["t"]
    return df.withColumn(out, F.try_divide(F.col(column) * F.lit(100.0), total))


def box_stats(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends (last value within 1.5 box heights) and the number of values beyond."""
    box = quantiles(df, key, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    box = box.withColumns({"__lo": F.col("q1") - reach, "__hi": F.col("q3") + reach})
    # equal values are counted first: what meets the box is distinct values, not rows
    values = df.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    if key:
        placed = join_null_safe(values, box, key, "inner")
    else:
        ends = box.select(F.struct("*").alias("b")).scalar()
        placed = values.withColumns({c: ends[c] for c in box.columns})
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    return placed.groupBy(*key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("__n"))).alias("fliers"),
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column and in total."""
    per = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return per.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def density(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of known cells per column and over all cells."""
    n = F.count(F.lit(1))
    known = reduce(lambda a, b: a + b, [F.count(c) for c in columns])
    return df.agg(
        *[F.try_divide(F.count(c), n).alias(c) for c in columns],
        F.try_divide(known, n * len(columns)).alias("all_cells"),
    )


def known_cells(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value) rows of the known cells only."""
    return _long(df, columns, key).filter(F.col("value").isNotNull())
