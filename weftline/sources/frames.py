"""Small constructors: labelled series and frames from rows, mappings and ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str], index: Sequence | None = None, label: str = "label") -> DataFrame:
    """Frame from rows of values; ``index`` gives a label to each row."""
    if index is not None:
        rows = [(lab, *row) for lab, row in zip(index, rows, strict=True)]
        columns = [label, *columns]
    return spark.createDataFrame([tuple(r) for r in rows], list(columns))


def series(spark: SparkSession, values: Sequence, index: Sequence | None = None) -> DataFrame:
    """(label, value) rows; labels may repeat and default to 0, 1, 2, …"""
    labels = list(index) if index is not None else list(range(len(values)))
    return spark.createDataFrame(list(zip(labels, values, strict=True)), ["label", "value"])


def constant(labels: DataFrame, value, name: str = "value") -> DataFrame:
    """The same value under every label."""
    return labels.withColumn(name, F.lit(value))


def lookup(labels: DataFrame, key: str, values: Mapping, name: str = "value") -> DataFrame:
    """Series from a mapping for given labels; a label the mapping lacks is null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return labels.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(key)))


def arange(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "value") -> DataFrame:
    return spark.range(start, stop, step).withColumnRenamed("id", name)


def zeros(spark: SparkSession, n: int, columns: Sequence[str]) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("label"), *[F.lit(0.0).alias(c) for c in columns])


def randoms(spark: SparkSession, n: int, columns: Sequence[str], seed: int, normal: bool = False) -> DataFrame:
    """Uniform or standard normal columns; each column has its own seed."""
    draw = F.randn if normal else F.rand
    cols: list[Column] = [draw(seed + i).alias(c) for i, c in enumerate(columns)]
    return spark.range(n).select(F.col("id").alias("label"), *cols)
