"""Merges on columns, joins on labels, concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe, left_join, outer_join, outer_join_all


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join where null keys match each other and shared columns get suffixes.

    The form of the join depends on the largest key of each side (see
    ``plans.joining``).
    """
    on = [on] if isinstance(on, str) else list(on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if how == "inner":
        out = join_null_safe(left, right, on, how)
    elif how == "left":
        out = left_join(left, right, on)
    elif how == "right":
        out = left_join(right, left, on)
    elif how == "outer":
        out = outer_join(left, right, on)
    else:
        raise ValueError("how is 'left', 'right', 'outer' or 'inner'")
    return out.select(*on, *[c for c in (*left.columns, *right.columns) if c not in on])


def join_index(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join on labels."""
    return left_join(left, right, key)


def concat_rows(frames: Sequence[DataFrame], keys: Sequence[str] | None = None, key: str = "source") -> DataFrame:
    """Bag union by column name, columns a frame lacks are null; ``keys`` names the source of each row."""
    if keys is not None:
        frames = [f.withColumn(key, F.lit(k)) for f, k in zip(frames, keys, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_cols(frames: Sequence[DataFrame], key: str, join: str = "outer", repeats: str = "pair") -> DataFrame:
    """Side by side on labels; a repeated column name gets the number of its frame.  Null is a label like others.

    With ``repeats="refuse"`` all frames go into one union and one aggregate by label, so there is one shuffle however many
    frames there are; a label that a frame holds twice fails the job, which names label and frame.  With "pair" the rows of a
    repeated label are paired with each other, by a join for each frame.
    """
    if join not in ("outer", "inner") or repeats not in ("pair", "refuse"):
        raise ValueError("join is 'outer' or 'inner', repeats 'pair' or 'refuse'")
    seen: set[str] = set()
    named, parts = [], []
    for i, f in enumerate(frames):
        cells = [c for c in f.columns if c != key]
        names = {c: f"{c}_{i}" if c in seen else c for c in cells}
        seen.update(cells)
        named.append(list(names.values()))
        parts.append(f.select(F.col(f"`{key}`"), F.lit(i).alias("__frame"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    if repeats == "pair":
        sides = [p.drop("__frame") for p in parts]
        return outer_join_all(sides, key) if join == "outer" else reduce(lambda x, y: join_null_safe(x, y, [key], "inner"), sides)
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    # a label is once in a frame, so the first known value of a column is its only one
    values = [F.first(f"`{n}`", ignorenulls=True).alias(n) for names in named for n in names]
    times = [F.count(F.when(F.col("__frame") == i, 1)).alias(f"__n{i}") for i in range(len(frames))]
    out = union.groupBy(f"`{key}`").agg(*values, *times)
    told = F.concat(F.lit("repeated label "), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    once = F.lit(True)
    for i in range(len(frames)):
        twice = F.raise_error(F.concat(told, F.lit(f" in frame {i}"))).cast("boolean")
        here = F.col(f"__n{i}") == 1
        once = once & F.when(F.col(f"__n{i}") > 1, twice).otherwise(here if join == "inner" else F.lit(True))
    return out.filter(once).drop(*[f"__n{i}" for i in range(len(frames))])
