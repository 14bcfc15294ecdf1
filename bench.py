"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is run in full into a sink that drops its rows.  Hourly bars of
five event types are few rows at any scale, so the series queries also run on
minute bars (five long series) and on hourly bars per user (many series).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import Line
from weftline.catalog import QUERIES
from weftline.operators import indicators as I
from weftline.operators import series as S
from weftline.sources.bars import bars

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "bars", "agg_global_sql", "filter_bool", "sort_values", "topk", "duplicated", "drop_duplicates",
    "merge_left", "merge_outer", "align", "arith_frames", "group_agg", "group_transform", "describe_numeric",
    "box_stats", "pivot_table_multi", "melt", "interpolate", "standardize", "str_replace_regex", "html_list_items",
    "message_decode", "path_forecast", "budget_allocate", "feature_frame", "feature_frame_grouped",
    "ml_forest", "ml_forest_per_ticker",
)


def events(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/events.parquet")


def minute_line(spark: SparkSession) -> Line:
    return Line.of(bars(events(spark), width="1 minute"), "ticker", "bar_ts")


def user_line(spark: SparkSession) -> Line:
    return Line.of(bars(events(spark), ticker="user_id"), "ticker", "bar_ts")


def ewm_minutes(spark: SparkSession) -> DataFrame:
    terms = {f"e{n}": (F.col("close"), S.alpha_of(span=n)) for n in (12, 26)}
    return S.ewm(minute_line(spark), terms, adjust=False).result()


LARGE = {
    "minute_ewm": ewm_minutes,
    "minute_dominant_period": lambda spark: I.dominant_period(minute_line(spark)).result(),
    "minute_feature_frame": lambda spark: I.feature_frame(minute_line(spark)),
    "user_feature_frame": lambda spark: I.feature_frame(user_line(spark)),
    "user_feature_frame_grouped": lambda spark: I.feature_frame_grouped(user_line(spark)),
}


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def calibration(spark: SparkSession) -> DataFrame:
    """Fixed work that reads no table and uses nothing of the library: what a machine's speed divides out by."""
    return spark.range(0, 200_000_000, 1, int(CPUS)).agg(F.sum(F.xxhash64("id") % 1000).alias("s"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("weftline-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weftline-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    # one pass over each table first, so that no query pays for a cold JVM
    for name in ("events", "lineitem", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").groupBy().count().collect()
    QUERIES["bars"](spark, SF).write.format("noop").mode("overwrite").save()
    steady = min(timed(lambda: calibration(spark)) for _ in range(3))
    took = {}
    for key in HEADLINE:
        if not wanted or key in wanted:
            took[key] = timed(lambda key=key: QUERIES[key](spark, SF))
    for key, run in LARGE.items():
        if not wanted or key in wanted:
            took[key] = timed(lambda run=run: run(spark))
    line = {
        "metric": "headline queries, total time",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(SF.rstrip("/")),
        "cpus": int(CPUS),
        "calibration": steady,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
