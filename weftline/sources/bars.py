"""Price bars made from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.sizing import one_row, written

VALUE_COLUMNS = ("open", "high", "low", "close", "volume")

# more than there are different values of a bigint, so that ids never reach into the moments
IDS = 2 * 10**19
LEAST_ID = -(2**63)
GRID_RUN = 4096


def micros(events: DataFrame, ts: str = "ts") -> Column:
    """Microseconds of a time, in its own order whatever the session's zone."""
    return F.unix_micros(ts) if dict(events.dtypes)[ts] == "timestamp" else wall_micros(F.col(ts))


def wall_micros(ts: Column) -> Column:
    """Microseconds of a time without zone."""
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86_400) + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def bars(events: DataFrame, ticker: str = "event_type", width: str = "1 hour") -> DataFrame:
    """Open, high, low, close and volume per ticker and time step.

    One hash aggregate with map-side combine; the first and last value of a step
    follow (ts, event_id), so the result does not depend on row order.  The two
    are packed into one decimal: a struct would ask for sorted rows instead.
    """
    at = micros(events).cast("decimal(19,0)") * F.lit(str(IDS)).cast("decimal(20,0)")
    moment = (at + F.coalesce(F.col("event_id").cast("decimal(19,0)"), F.lit(str(LEAST_ID)).cast("decimal(19,0)"))).cast("decimal(38,0)")
    size = F.get_json_object("props", "$.k").cast("double")
    return (
        events.filter(F.col(ticker).isNotNull())
        .groupBy(F.col(ticker).cast("string").alias("ticker"), F.window("ts", width).start.alias("bar_ts"))
        .agg(
            F.min_by("value", moment).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", moment).alias("close"),
            F.sum(size).alias("volume"),
        )
    )


def bars_grid(priced: DataFrame, step: str = "interval 1 hour") -> DataFrame:
    """Bars on a full time grid from the first to the last day; steps without a bar are null.

    The grid is unfolded per ticker from its two end points, so no join of all
    tickers with all steps is made before the (ticker, step) key exists; it is
    unfolded in runs of ``GRID_RUN`` steps, so no row ever holds a whole grid.
    Span, tickers and values come from one writing of the bars, so that what
    they are made from is read once.
    """
    priced = written(priced, "bars")
    ends = one_row(priced, {"first": F.min("bar_ts"), "last": F.max("bar_ts")})
    start = F.to_date(ends["first"]).cast("timestamp_ntz")
    stop = F.date_add(F.to_date(ends["last"]), 1).cast("timestamp_ntz") - F.expr(step)
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    width = wall_micros(origin + F.expr(step)) - wall_micros(origin)
    last = F.floor((wall_micros(stop) - wall_micros(start)) / width)
    runs = priced.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(GRID_RUN))).alias("run"))
    upto = F.least(F.col("run") + GRID_RUN - 1, last)
    steps = runs.select("ticker", F.explode(F.sequence("run", upto)).alias("step"))
    grid = steps.select("ticker", (start + F.expr(step) * F.col("step")).alias("bar_ts"))
    return grid.join(priced, ["ticker", "bar_ts"], "left")
