"""Exact quantiles with linear interpolation, also for groups that fit no task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.joining import join_null_safe
from weftline.plans.ordered import Line
from weftline.plans.sizing import GroupSizes, group_sizes, rows_per_task, written

BINS = 4096
FEW_GROUPS = 10_000


def quantiles(
    df: DataFrame,
    keys: list[str] | tuple[str, ...],
    value: str,
    wanted: dict[str, float],
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """One row per group of ``keys`` with the ``wanted`` quantiles of ``value``; known ``sizes`` (upper bounds do) save the check.

    ``percentile`` keeps all distinct values of a group in one task, so it is
    used only while the largest group fits one.
    """
    limit = limit or rows_per_task(df.sparkSession)
    df = df.select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = sizes or group_sizes(df, keys)
    if sizes.largest <= limit:
        # one call for all quantiles: one sorted buffer per group
        found = df.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(q) for q in wanted.values()])).alias("__q"))
        return found.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(wanted)])
    picked = _by_bins(df.filter(F.col("__v").isNotNull()), tuple(keys), wanted, sizes, limit)
    # a group that holds nulls only keeps its row
    return join_null_safe(df.select(*keys).distinct(), picked, keys, "left") if keys else picked


def _by_bins(rows: DataFrame, keys: tuple[str, ...], wanted: dict[str, float], sizes: GroupSizes, limit: int) -> DataFrame:
    """Selection by counting: find the bin that holds a rank, then the value inside that bin.

    Both steps are counts that combine before the shuffle.  Only the bins that
    hold a wanted rank are looked into, and a bin that is itself too large is
    summed along its values by ``Line`` in blocks.
    """
    stats = {"__lo": F.min("__v"), "__hi": F.max("__v"), "__n": F.count("__v")}
    ends = rows.groupBy(*keys).agg(*[a.alias(n) for n, a in stats.items()])
    counts = _in_bins(rows, ends, keys, sizes).groupBy(*keys, "__bin", *stats).agg(F.count(F.lit(1)).alias("__c"))
    # at most one row per group and bin, read twice below
    counts = written(counts, "quantile-bins")

    along = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    picks = counts.withColumn("__before", F.coalesce(F.sum("__c").over(along), F.lit(0)))
    picks = picks.select(*keys, "__bin", "__c", "__before", F.inline(F.array(*_ranks(wanted))))
    picks = picks.filter((F.col("__before") <= F.col("rank")) & (F.col("rank") < F.col("__before") + F.col("__c")))
    most = picks.agg(F.max("__c").alias("most"), F.sum("__c").alias("all")).first()
    picks = picks.drop("__c")
    if sizes.groups <= FEW_GROUPS:  # two ranks per group and quantile
        picks = F.broadcast(picks)

    binned = _in_bins(rows, counts.select(*keys, *stats).distinct(), keys, sizes)
    held = join_null_safe(binned.select(*keys, "__bin", "__v"), picks, (*keys, "__bin"), "inner")
    label = (*keys, "q", "side")
    held = held.groupBy(*label, "rank", "share", "__before", "__v").agg(F.count(F.lit(1)).alias("__c"))
    bound = GroupSizes(most["all"] or 0, sizes.groups, most["most"] or 0)
    line = Line.of(held, label, "__v", limit, bound).scan(sums={"__upto": F.col("__c")})
    upto = F.col("__before") + F.col("__upto")
    hit = line.result().filter((upto - F.col("__c") <= F.col("rank")) & (F.col("rank") < upto))

    def side(name: str, which: str, column: str) -> Column:
        return F.max(F.when((F.col("q") == name) & (F.col("side") == which), F.col(column)))

    exact = []
    for name in wanted:
        lo, hi = side(name, "lo", "__v"), side(name, "hi", "__v")
        exact.append((lo + (hi - lo) * side(name, "lo", "share")).alias(name))
    return hit.groupBy(*keys).agg(*exact)


def _in_bins(rows: DataFrame, ends: DataFrame, keys: tuple[str, ...], sizes: GroupSizes) -> DataFrame:
    """Each value with its bin between the ends of its group; bins follow the value order."""
    if keys:
        rows = join_null_safe(rows, F.broadcast(ends) if sizes.groups <= FEW_GROUPS else ends, keys, "inner")
    else:
        end = ends.select(F.struct("*").alias("e")).scalar()
        rows = rows.withColumns({n: end[n] for n in ("__lo", "__hi", "__n")})
    width = F.col("__hi") - F.col("__lo")
    share = (F.col("__v") - F.col("__lo")) / width
    spread = (width > 0) & (width < F.lit(float("inf")))
    place = F.when(spread, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    return rows.withColumn("__bin", place.cast("int"))


def _ranks(wanted: dict[str, float]) -> list[Column]:
    """The two ranks around each quantile, and how far it lies between them."""
    out = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("__n") - 1)
        for which, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            out.append(
                F.struct(
                    F.lit(name).alias("q"),
                    F.lit(which).alias("side"),
                    rank.cast("long").alias("rank"),
                    (at - F.floor(at)).alias("share"),
                )
            )
    return out


