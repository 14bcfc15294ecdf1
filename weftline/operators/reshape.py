"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.stats import STATS

MOST_LABELS = 1000


def melt(
    df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value"
) -> DataFrame:
    """One row per cell; missing cells stay."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def stack(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], var_name: str = "column", value_name: str = "value"
) -> DataFrame:
    """One row per known cell."""
    return melt(df, key, columns, var_name, value_name).filter(F.col(value_name).isNotNull())


def stack_level(df: DataFrame, key: Sequence[str], level: int = 1, sep: str = "_", var_name: str = "level") -> DataFrame:
    """Move one level of ``high_low`` columns into rows; the other level stays as columns."""
    cells = [c for c in df.columns if c not in key]
    moved = list(dict.fromkeys(c.split(sep, 1)[level] for c in cells))
    stay = list(dict.fromkeys(c.split(sep, 1)[1 - level] for c in cells))

    def name(m, s):
        return s + sep + m if level == 1 else m + sep + s

    kinds = dict(df.dtypes)
    kind = {s: next(kinds[name(m, s)] for m in moved if name(m, s) in cells) for s in stay}
    rows = [
        F.struct(
            F.lit(m).alias(var_name),
            *[
                (F.col(name(m, s)) if name(m, s) in cells else F.lit(None).cast(kind[s])).alias(s)
                for s in stay
            ],
        )
        for m in moved
    ]
    out = df.select(*key, F.inline(F.array(*rows)))
    some = F.coalesce(*[F.col(s).isNotNull() for s in stay]) if len(stay) == 1 else None
    return out.filter(some) if some is not None else out.na.drop("all", subset=stay)


def labels_of(df: DataFrame, column: str, most: int = MOST_LABELS) -> list:
    """Distinct values of a column that are to become columns; refuses more than ``most``."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; they cannot all become columns")
    return sorted(v for v in found if v is not None)


def _labels(df: DataFrame, column: str, labels: Sequence | None) -> list:
    """The labels of a column; a given list must hold them all, as rows of others would be lost."""
    found = labels_of(df, column)
    if labels is None:
        return found
    lost = set(found) - set(labels)
    if lost:
        raise ValueError(f"labels of {column} that are not in the list: {sorted(map(str, lost))[:5]}")
    return list(labels)


def unstack(df: DataFrame, key: Sequence[str], column: str, value: str, labels: Sequence | None = None, check: bool = True) -> DataFrame:
    """Labels of one level become columns; a repeated (key, label) pair is an error."""
    labels = _labels(df, column, labels)
    if check:
        twice = df.groupBy(*key, column).count().filter(F.col("count") > 1).limit(1).count()
        if twice:
            raise ValueError("a label pair occurs more than once")
    return df.groupBy(*key).pivot(column, list(labels)).agg(F.first(value))


def transpose(df: DataFrame, key: str, columns: Sequence[str], labels: Sequence | None = None, kind: str = "string") -> DataFrame:
    """Columns become rows, row labels become columns."""
    labels = _labels(df, key, labels)
    long = df.select(key, *[F.col(c).cast(kind) for c in columns]).unpivot([key], list(columns), "column", "value")
    wide = long.groupBy("column").pivot(key, list(labels)).agg(F.first("value"))
    return wide.toDF("column", *[str(x) for x in labels])


def pivot_table(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    aggs: Mapping[str, str | Sequence[str]],
    labels: Sequence | None = None,
) -> DataFrame:
    """Grouped statistics spread over the values of ``columns``.

    Outputs are ``<value>_<label>`` for one statistic and
    ``<value>_<stat>_<label>`` for a list; a pair that does not occur is null.
    """
    labels = _labels(df, columns, labels)
    df = df.na.drop(subset=[*index, columns])
    plan = []
    for value, stats in aggs.items():
        single = isinstance(stats, str)
        for s in [stats] if single else stats:
            plan.append((f"{value}" if single else f"{value}_{s}", STATS[s](F.col(value))))
    wide = df.groupBy(*index).pivot(columns, list(labels)).agg(*[a.alias(n) for n, a in plan])
    if len(plan) == 1:
        return wide.select(*index, *[F.col(f"`{x}`").alias(f"{plan[0][0]}_{x}") for x in labels])
    return wide.select(*index, *[F.col(f"`{x}_{n}`").alias(f"{n}_{x}") for n, _ in plan for x in labels])
