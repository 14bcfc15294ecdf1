"""Group operators.  Rows without a group key are left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.plans.ordered import BLOCK, POS, Line


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return _keyed(df, keys).groupBy(*keys).agg(*[a.alias(o) for o, a in aggs.items()])


def group_transform(df: DataFrame, keys: Sequence[str], row_key: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """The aggregate of its group on every row; the group key leaves the output.

    The group table is aggregated first and joined back: a hot group is
    combined before the shuffle, and adaptive execution broadcasts the group
    table when it turns out small or splits the hot key when it is not.
    """
    totals = group_agg(df, keys, aggs)
    return df.select(*row_key, *[k for k in keys if k not in row_key]).join(totals, list(keys), "left").select(
        *row_key, *aggs
    )


def group_sum_with_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sum of every column per group, the key column included (as ``<key>_sum``)."""
    return group_agg(df, [key], {f"{key}_sum": F.sum(key), **{c: F.sum(c) for c in columns}})


def group_level(df: DataFrame, level: str, columns: Sequence[str], agg: Callable[[Column], Column] = F.max) -> DataFrame:
    """Aggregate over all rows that share one row level."""
    return group_agg(df, [level], {c: agg(F.col(c)) for c in columns})


def group_level_cols(df: DataFrame, key: Sequence[str], level: int = 0, sep: str = "_") -> DataFrame:
    """Greatest value over the columns ``high_low`` that share a level."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c not in key:
            groups.setdefault(c.split(sep, 1)[level], []).append(c)
    return df.select(
        *key, *[(F.greatest(*cs) if len(cs) > 1 else F.col(cs[0])).alias(g) for g, cs in groups.items()]
    )


def group_frames(line: Line, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A pandas function per whole group, rows in order; it may return any number of rows.

    A group is one pandas frame on one worker at every size, and none is refused: where groups outgrow a worker, use
    ``group_stream``, ``group_rows``, an aggregate or ``Line.scan``.
    """
    order = [POS] if line.split else list(line.order)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        return fn(pdf.drop(columns=[POS], errors="ignore"))

    return line.df.groupBy(*line.keys).applyInPandas(whole, schema)


def group_stream(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """A function that reads a whole group batch by batch, in order, and yields batches of any number of rows.

    ``fn`` is given the group's key values and an iterator of its Arrow batches (all columns of ``df``); what it keeps
    between batches is its state, so a group may be larger than a worker's memory.  Its batches are cast to ``schema``.  A group is read by one task: the rows
    are dealt by key and sorted by key and order on Spark's side, which spills.  Nulls in a key are a group like others; what
    ``fn`` leaves unread of its group is passed over.
    """
    keys, order = list(keys), list(order)
    columns = df.columns
    at = [columns.index(k) for k in keys]
    told = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    dealt = df.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.asc_nulls_last(f"`{c}`") for c in (*keys, *order)])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Key and rows of each stretch of one group inside a batch."""
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                key = tuple(batch.column(i)[start].as_py() for i in at)
                end = _last_of(batch, at, key, start)
                yield key, batch.slice(start, end - start)
                start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(runs(batches), key=lambda r: _comparable(r[0])):
            first = next(group)
            mine = (rows for _, rows in chain([first], group))
            for made in fn(first[0], mine):
                yield made.select(told.names).cast(told)
            for _ in mine:
                pass

    return dealt.mapInArrow(run, schema)


def _comparable(key: tuple) -> tuple:
    """NaN keys are one group for Spark."""
    return tuple("NaN" if isinstance(k, float) and k != k else k for k in key)


def _last_of(batch: pa.RecordBatch, at: Sequence[int], key: tuple, start: int) -> int:
    """One behind the last row of the group that begins at ``start``; rows of a group stand together."""
    lo, hi = start + 1, batch.num_rows
    if _comparable(tuple(batch.column(i)[hi - 1].as_py() for i in at)) == _comparable(key):
        return hi
    while lo < hi:
        mid = (lo + hi) // 2
        same = _comparable(tuple(batch.column(i)[mid].as_py() for i in at)) == _comparable(key)
        lo, hi = (mid + 1, hi) if same else (lo, mid)
    return lo


def group_rows(
    line: Line, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, before: int, after: int = 0
) -> DataFrame:
    """A row-for-row pandas function over ordered groups that looks ``before`` and ``after`` rows away at most.

    At every size it is given blocks of positions with the rows around them, and must return one row for each row it
    is given; anything else fails the job.
    """
    if not line.split:
        line = line.with_position(POS)
    size = max(line.block, before, after)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        own = (pdf[POS] // size == pdf[BLOCK]).to_numpy()
        out = fn(pdf.drop(columns=[POS, BLOCK])).reset_index(drop=True)
        if len(out) != len(own):
            raise ValueError(f"the function returned {len(out)} rows for {len(own)}; group_frames takes such functions")
        return out[own]

    home = F.floor(F.col(POS) / size).cast("long")
    at = F.col(POS) % size
    homes = [
        home,
        F.when(at >= size - before, home + 1),
        F.when((at < after) & (home > 0), home - 1),
    ]
    spread = line.df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*homes))))
    return spread.groupBy(*line.keys, BLOCK).applyInPandas(part, schema)


# -- ordered categories --------------------------------------------------------


def category_code(c: Column, categories: Sequence[str]) -> Column:
    """Place of a value in the category list; null for a value outside it."""
    place = F.array_position(F.array(*[F.lit(x) for x in categories]), c)
    return F.nullif(place, F.lit(0)) - 1


def category_sort(df: DataFrame, column: str, categories: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows in category order; values outside the list are null and come last."""
    df = df.withColumn(f"{column}_code", category_code(F.col(column), categories).cast("long"))
    df = df.withColumn(column, F.when(F.col(f"{column}_code").isNotNull(), F.col(column)))
    return df.orderBy(F.asc_nulls_last(f"{column}_code"), *[F.asc_nulls_last(c) for c in then])


def category_size(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Rows per category, categories without rows included with 0."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("size"))
    listed = df.sparkSession.createDataFrame([(c,) for c in categories], f"`{column}` string")
    return listed.join(counts, column, "left").withColumn("size", F.coalesce("size", F.lit(0)))
