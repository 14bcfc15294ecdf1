"""Size checks that decide between a one-task-per-group plan and a split plan."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK_KEY = "weftline.rowsPerTask"
ROWS_PER_TASK_DEFAULT = 1_000_000


def rows_per_task(spark: SparkSession) -> int:
    """The largest group one task may hold; set ``weftline.rowsPerTask`` to change it."""
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(ROWS_PER_TASK_DEFAULT)))


@dataclass(frozen=True)
class GroupSizes:
    rows: int
    groups: int
    largest: int


def group_sizes(df: DataFrame, keys: list[str] | tuple[str, ...]) -> GroupSizes:
    """Row total, number of groups and largest group: one row comes back.

    Counts are combined before the shuffle, so a hot key costs nothing extra.
    """
    if not keys:
        n = df.count()
        return GroupSizes(n, 1, n)
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__size"))
        .agg(F.sum("__size").alias("rows"), F.count("__size").alias("groups"), F.max("__size").alias("largest"))
        .first()
    )
    return GroupSizes(row["rows"] or 0, row["groups"] or 0, row["largest"] or 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="weftline-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this session's own folder below the shared one; the folder goes when the driver's JVM ends."""
    top = f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{top}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table as Parquet in the shared folder, read back.

    Later stages prune columns, the past is not worked out again, and a lost executor costs a read.  ``by`` becomes
    folders, so that a filter on it reads only its own files.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def one_row(df: DataFrame, aggs: dict[str, Column]) -> dict[str, Column]:
    """Whole-table aggregates as one scalar subquery of one row: lazy, and no join."""
    if not aggs:
        return {}
    row = df.agg(F.struct(*[agg.alias(name) for name, agg in aggs.items()]).alias("row")).scalar()
    return {name: row[name] for name in aggs}
