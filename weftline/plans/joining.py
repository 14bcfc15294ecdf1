"""Equi-joins where null keys match each other, in forms that adaptive execution can split.

Adaptive execution splits a hot key on both sides of an inner join and on the
kept side of a left join, but not on the other side, and on neither side of a
full join.  So the largest key of a side that could not be split is counted
first (keys only, combined before the shuffle).  While it fits a task the plain
join is best.  Beyond that the result is put together from the inner join and
the rows without partner.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.sizing import group_sizes, rows_per_task, written


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in names.items()])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equally named keys where null matches null; the right keys are dropped."""
    names = {k: f"__r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    return left.join(right, _same(left, right, names), how).drop(*names.values())


def without_partner(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys ``other`` lacks; ``other`` is cut down to its distinct keys first."""
    return join_null_safe(df, other.select(*keys).distinct(), keys, "left_anti")


def _fits(df: DataFrame, keys: Sequence[str]) -> bool:
    return group_sizes(df, keys).largest <= rows_per_task(df.sparkSession)


def left_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """All left rows; columns other than the keys must have different names."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if _fits(right, keys):
        return join_null_safe(left, right, keys, "left")
    both = join_null_safe(left, right, keys, "inner")
    return both.unionByName(without_partner(left, right, keys), allowMissingColumns=True)


def outer_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """All rows of both sides; columns other than the keys must have different names."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if _fits(left, keys) and _fits(right, keys):
        names = {k: f"__r_{k}" for k in keys}
        sided = right.withColumnsRenamed(names)
        both = left.join(sided, _same(left, sided, names), "full")
        return both.withColumns({k: F.coalesce(k, r) for k, r in names.items()}).drop(*names.values())
    both = join_null_safe(left, right, keys, "inner")
    both = both.unionByName(without_partner(left, right, keys), allowMissingColumns=True)
    return both.unionByName(without_partner(right, left, keys), allowMissingColumns=True)


def outer_join_all(frames: Sequence[DataFrame], keys: str | Sequence[str]) -> DataFrame:
    """Outer join of many frames, left to right.

    A joined part that holds a hot key would be read several times by the next
    join, so it is written first.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = frames[0]
    for i, frame in enumerate(frames[1:], 1):
        out = outer_join(out, frame, keys)
        if i + 1 < len(frames) and not _fits(frame, keys):
            out = written(out, "outer-join")
    return out
