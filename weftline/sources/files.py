"""Parquet and CSV reads, a write-once cache, and unions of keyed inputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    where: Column | str | None = None,
    view: str | None = None,
) -> DataFrame:
    """Lazy Parquet read; the filter and the column list reach the scan."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*columns)
    return register_table(df, view) if view else df


def register_table(df: DataFrame, name: str, persist: bool = False) -> DataFrame:
    """Make ``df`` known to SQL as ``name`` and read it back by that name."""
    if persist:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def sink_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrite ``path``; ``by`` columns become folders, so a filter on them skips files."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def cached(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    by: list[str] | None = None,
    force: bool = False,
) -> DataFrame:
    """Read ``path`` when a finished write is there, else build, write and read.

    Only a write that left its success marker counts, so a half-written cache
    is built again.
    """
    if force or not _finished(spark, path):
        sink_parquet(build(), path, by)
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: list[str] | None = None,
    na_values: list[str] | None = None,
    nrows: int | None = None,
    header: bool = True,
    na_filter: bool = True,
    infer: bool = False,
    dates: bool = False,
    index_col: str | int | None = None,
) -> DataFrame:
    """CSV read where any ``na_values`` token, in any column, is null.

    Cells are read as text, tokens become null, and then the schema is applied;
    a token in a number column would otherwise hide behind a failed cast.
    Without a schema the columns stay text, or get the types that ``infer_types``
    finds with ``infer`` (and ``dates``); the usual tokens for missing values
    are then missing too.  ``index_col`` (a name or a place) comes first, as the
    label.  ``na_filter=False`` keeps every cell, empty ones included, as it is
    written.  ``nrows`` takes the first rows
    in the order of file name and place in the file: an ordered limit, combined
    before its shuffle.
    """
    reader = spark.read.option("header", header).option("inferSchema", False)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is not None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        reader = reader.schema(text)
    df = reader.csv(path)
    place = []
    if nrows is not None:
        place = ["__file", "__block", "__row"]
        at = (F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
        df = df.withColumns(dict(zip(place, at, strict=True)))
    if columns is not None:
        df = df.select(*columns, *place)
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    out = []
    for c in df.columns:
        cell = F.col(c)
        if c in place:
            out.append(cell)
            continue
        if na_filter and na_values:
            cell = F.when(~cell.isin(na_values), cell)
        if not na_filter and dict(df.dtypes)[c] == "string":
            cell = F.coalesce(cell, F.lit(""))
        out.append((cell.cast(types[c]) if c in types else cell).alias(c))
    df = df.select(*out)
    if nrows is not None:
        df = df.orderBy(*place).limit(nrows).drop(*place)
    if infer and schema is None:
        if na_filter:
            df = df.select(*[F.when(~F.col(f"`{c}`").isin(list(NA_TOKENS)), F.col(f"`{c}`")).alias(c) for c in df.columns])
        found = infer_types(df, dates)
        df = df.select(*[_typed(F.col(f"`{c}`"), found[c]).alias(c) for c in df.columns])
    if index_col is not None:
        first = df.columns[index_col] if isinstance(index_col, int) else index_col
        df = df.select(f"`{first}`", *[f"`{c}`" for c in df.columns if c != first])
    return df


# The usual tokens for a missing cell, and how numbers, truth values and days are written.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ENDLESS = r"^\s*[+-]?(?i:inf|infinity)\s*$"
TRUTH = r"^(?i:true|false)$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$"


def infer_types(df: DataFrame, dates: bool = False) -> dict[str, str]:
    """The type of each text column: bigint, double, boolean, date or timestamp_ntz where all known cells are that, else string.

    One aggregate for all columns: a column's place between its possible types is a few counts, which any split of the rows
    adds up to.  Whole numbers with missing cells are doubles and truth values with missing cells stay text, as is usual
    for labelled tables; whole numbers beyond 64 bits are doubles too.  Days and moments are looked for with ``dates``
    only.  A column without a known cell is double.
    """
    kinds = {"whole": WHOLE, "number": NUMBER, "endless": ENDLESS, "truth": TRUTH, "day": DAY, "moment": MOMENT}
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        cell = F.col(f"`{c}`")
        counts.append(F.count(cell).alias(f"known{i}"))
        counts += [F.count(F.when(cell.rlike(p), 1)).alias(f"{k}{i}") for k, p in kinds.items()]
        for k, p, t in (("fits", WHOLE, "bigint"), ("real", DAY, "date"), ("real2", MOMENT, "timestamp_ntz")):
            counts.append(F.count(F.when(cell.rlike(p), F.trim(cell).try_cast(t))).alias(f"{k}{i}"))
    row = df.agg(*counts).first()

    def of(i: int) -> str:
        known, all_known = row[f"known{i}"], row[f"known{i}"] == row["n"]
        if not known:
            return "double"
        if row[f"fits{i}"] == known:
            return "bigint" if all_known else "double"
        if row[f"number{i}"] + row[f"endless{i}"] == known:
            return "double"
        if row[f"truth{i}"] == known and all_known:
            return "boolean"
        if dates and row[f"real{i}"] == known:
            return "date"
        if dates and row[f"real{i}"] + row[f"real2{i}"] == known:
            return "timestamp_ntz"
        return "string"

    return {c: of(i) for i, c in enumerate(df.columns)}


def _typed(cell: Column, kind: str) -> Column:
    if kind == "string":
        return cell
    if kind == "double":
        endless = F.when(cell.rlike(ENDLESS), F.when(cell.contains("-"), float("-inf")).otherwise(float("inf")))
        return F.coalesce(endless, F.trim(cell).try_cast("double"))
    return F.trim(cell).cast(kind)


def union_keyed(inputs: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of inputs with their dictionary key as a column; empty inputs vanish."""
    parts = [df.withColumn(key, F.lit(name)) for name, df in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Period names.
PERIODS = {
    "1d": dict(days=1),
    "5d": dict(days=5),
    "1mo": dict(months=1),
    "3mo": dict(months=3),
    "6mo": dict(months=6),
    "1y": dict(years=1),
    "2y": dict(years=2),
    "5y": dict(years=5),
    "10y": dict(years=10),
}


def relative_period(df: DataFrame, period: str, ts: str = "bar_ts", key: str = "ticker") -> DataFrame:
    """Rows of the last ``period`` of each key, counted back from the key's last row.

    ``max`` keeps everything.  The anchor is one aggregate row per key.
    """
    if period == "max":
        return df
    back = F.make_interval(**{k: F.lit(v) for k, v in PERIODS[period].items()})
    anchor = df.groupBy(key).agg((F.max(ts) - back).alias("__from"))
    return df.join(anchor, key).filter(F.col(ts) >= F.col("__from")).drop("__from")
