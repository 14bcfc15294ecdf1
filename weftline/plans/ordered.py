"""Ordered rows: exact positions, row frames and running scans that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  ``Line``
checks the largest key first.  When it fits one task the plain window is used:
one shuffle, one sort.  When it does not, rows get exact positions by a range
shuffle on (key, order), and windows run over fixed-size blocks of positions:

* bounded frames copy the few rows they look back (or ahead) on into the
  neighbouring block, so every block can be worked on alone;
* running sums and fills run inside the block, and one summary row per block
  is scanned to carry the state across.

Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe
from weftline.plans.sizing import (
    GroupSizes,
    group_sizes,
    one_row,
    rows_per_task,
    written,
)

POS = "__pos"
BLOCK = "__block"
CUT = "__cut"
# range partitions of the positioning shuffle; above it they get longer (and
# spill), as the number of shuffle blocks would outgrow the scheduler
MOST_CUTS = 32_768


@dataclass(frozen=True)
class Frame:
    """Where a window expression runs: its partition columns and its row order.

    ``chunk`` is the length of the chunks a recurrence works in; the chunk
    number then leads the order, which keeps the rows in the same sequence, so
    windows per chunk and windows per part share one sort.
    """

    parts: tuple[str, ...]
    order: tuple[str, ...]
    chunk: int | None = None

    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.spec().rowsBetween(lo, hi)

    def upto(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)

    def past(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Line:
    """A DataFrame whose rows are ordered by ``order`` within ``keys``.

    ``order`` must identify a row within its key; otherwise equal rows have no
    defined position.  Labels in ``keys`` may be null (null is one key).
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    block: int

    @staticmethod
    def of(
        df: DataFrame,
        keys: str | list[str] | tuple[str, ...],
        order: str | list[str] | tuple[str, ...],
        limit: int | None = None,
        sizes: GroupSizes | None = None,
    ) -> Line:
        """Checks the largest key and picks the plan; known ``sizes`` (upper bounds do) save the check."""
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        order = (order,) if isinstance(order, str) else tuple(order)
        limit = limit or rows_per_task(df.sparkSession)
        sizes = sizes or group_sizes(df, keys)
        if sizes.largest <= limit:
            return Line(df, keys, order, False, limit)
        placed = _place(df, keys, order, min(max(2, 2 * math.ceil(sizes.rows / limit)), MOST_CUTS))
        return Line(placed, keys, order, True, limit)

    # -- plumbing ---------------------------------------------------------

    def frame(self) -> Frame:
        """The frame of a whole key; only for a line that is not split."""
        return Frame(self.keys, self.order)

    def result(self) -> DataFrame:
        return self.df.drop(POS)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Line:
        """Row-wise change that keeps every row."""
        return replace(self, df=fn(self.df))

    def with_position(self, name: str) -> Line:
        """0-based exact position of the row within its key."""
        if self.split:
            return self.map(lambda d: d.withColumn(name, F.col(POS)))
        return self.map(
            lambda d: d.withColumn(name, (F.row_number().over(self.frame().spec()) - 1).cast("long"))
        )

    # -- bounded frames ---------------------------------------------------

    def roll(self, fn: Callable[[DataFrame, Frame], DataFrame], before: int = 0, after: int = 0) -> Line:
        """Run window expressions that look at most ``before``/``after`` rows away.

        ``fn(df, frame)`` adds columns; it may chain several windows as long as
        the total reach stays within the two bounds.
        """
        if not self.split:
            return replace(self, df=fn(self.df, self.frame()))
        size = max(self.block, before, after)
        home = F.floor(F.col(POS) / size).cast("long")
        at = F.col(POS) % size
        homes = [home]
        if before:
            homes.append(F.when(at >= size - before, home + 1))
        if after:
            homes.append(F.when((at < after) & (home > 0), home - 1))
        spread = self.df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*homes))))
        done = fn(spread, Frame((*self.keys, BLOCK), (POS,)))
        done = done.filter(F.col(BLOCK) == home).drop(BLOCK)
        return replace(self, df=done)

    # -- running state over the whole key ---------------------------------

    def scan(
        self,
        sums: dict[str, Column] | None = None,
        lasts: dict[str, Column] | None = None,
        nexts: dict[str, Column] | None = None,
        strict: bool = False,
    ) -> Line:
        """Running sums, last known and next known values over the whole key.

        ``strict`` leaves the current row out of ``lasts`` and ``nexts``.
        Null terms of a sum count as nothing (the running sum goes on).
        """
        sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
        src = {out: f"__s_{out}" for out in (*sums, *lasts, *nexts)}
        given = {**sums, **lasts, **nexts}
        df = self.df.withColumns({src[o]: c for o, c in given.items()})

        if not self.split:
            f = self.frame()
            cols = self._local_scan(f, src, sums, lasts, nexts, strict)
            return replace(self, df=df.withColumns(cols).drop(*src.values()))

        df = df.withColumn(BLOCK, F.floor(F.col(POS) / self.block).cast("long"))
        f = Frame((*self.keys, BLOCK), (POS,))
        df = df.withColumns(self._local_scan(f, src, sums, lasts, nexts, strict))
        # read twice from here on (block ends, then rows): written once, so that
        # a chain of scans does not work out its past again for every branch
        df = written(df, "line-scan")
        known = {o: F.when(F.col(src[o]).isNotNull(), F.col(POS)) for o in (*lasts, *nexts)}
        ends = df.groupBy(*self.keys, BLOCK).agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.sum(src[o]).alias(f"__e_{o}") for o in sums],
            *[F.max_by(src[o], known[o]).alias(f"__e_{o}") for o in lasts],
            *[F.min_by(src[o], known[o]).alias(f"__e_{o}") for o in nexts],
        )
        across = Window.partitionBy(*self.keys).orderBy(BLOCK)
        back = Window.partitionBy(*self.keys).orderBy(F.desc(BLOCK))
        prior = (Window.unboundedPreceding, -1)
        carry = ends.select(
            *self.keys,
            BLOCK,
            *[F.sum(f"__e_{o}").over(across.rowsBetween(*prior)).alias(f"__c_{o}") for o in sums],
            *[F.last(f"__e_{o}", True).over(across.rowsBetween(*prior)).alias(f"__c_{o}") for o in lasts],
            *[F.last(f"__e_{o}", True).over(back.rowsBetween(*prior)).alias(f"__c_{o}") for o in nexts],
        )
        df = join_null_safe(df, carry, (*self.keys, BLOCK), "left")
        joined = {
            **{
                o: F.when(
                    F.col(o).isNotNull() | F.col(f"__c_{o}").isNotNull(),
                    F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"__c_{o}"), F.lit(0)),
                )
                for o in sums
            },
            **{o: F.coalesce(F.col(o), F.col(f"__c_{o}")) for o in (*lasts, *nexts)},
        }
        df = df.withColumns(joined).drop(BLOCK, *src.values(), *[f"__c_{o}" for o in given])
        return replace(self, df=df)

    @staticmethod
    def _local_scan(f: Frame, src, sums, lasts, nexts, strict) -> dict[str, Column]:
        over = f"OVER (PARTITION BY {_sql_names(f.parts) or 'NULL'} ORDER BY {_sql_names(f.order)})"
        cols: dict[str, Column] = {o: F.sum(src[o]).over(f.upto()) for o in sums}
        for o in lasts:
            cols[o] = F.last(src[o], True).over(f.past() if strict else f.upto())
        for o in nexts:
            # a frame that runs to the end is re-read for every row; an offset
            # function that skips nulls is one pass
            ahead = F.expr(f"lead(`{src[o]}`) IGNORE NULLS {over}")
            cols[o] = ahead if strict else F.coalesce(F.col(src[o]), ahead)
        return cols

    # -- whole-key aggregates ----------------------------------------------

    def whole(self, aggs: dict[str, Column]) -> Line:
        """One aggregate per key, put on every row of the key."""
        if not self.keys:
            return self.map(lambda d: d.withColumns(one_row(d, aggs)))
        if not self.split:
            w = Window.partitionBy(*self.keys)
            return self.map(lambda d: d.withColumns({o: a.over(w) for o, a in aggs.items()}))
        totals = self.df.groupBy(*self.keys).agg(*[a.alias(o) for o, a in aggs.items()])
        return replace(self, df=join_null_safe(self.df, totals, self.keys, "left"))


def _sql_names(names: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _place(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], cuts: int) -> DataFrame:
    """Exact 0-based positions within each key without a one-task-per-key window.

    The range shuffle draws its bounds from a sample, so its result is written
    to the shared folder before it is read twice (counts, then rows).
    """
    ranged = df.repartitionByRange(cuts, *keys, *order).withColumn(CUT, F.spark_partition_id())
    ranged = written(ranged, "line-cuts")
    per_cut = ranged.groupBy(*keys, CUT).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cut.select(*keys, CUT, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, CUT).orderBy(*order)
    rows = ranged.withColumn(POS, (F.row_number().over(inside) - 1).cast("long"))
    rows = join_null_safe(rows, offsets, (*keys, CUT), "left")
    return rows.withColumn(POS, F.col(POS) + F.col("__off")).drop(CUT, "__off")
