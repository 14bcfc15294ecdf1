"""Mixing sources to target weights by nested histograms of a row's hash.

Every document has a fixed hash of 48 bits.  A budget below a source's size is met by a threshold: documents with a
smaller hash are taken.  The threshold is found without sorting: sizes are summed by source and hash bucket (4,096
buckets), a running sum over the buckets finds the one that holds the budget's edge, and only that bucket is split
into 4,096 again, four times, which is the whole hash.  A larger budget takes a superset of a smaller one.  Rows that
are equal in id and text share their hash; where a budget's edge falls among them, as many are taken as bring the sum
nearest to the budget, by a count of rows.

Scale: the narrow table of sizes is written once and read three times: for the first histogram (which also gives the
sizes of the sources, and serves all copies), for the boundary buckets (one row for each hash, a 4,096th of all; the
further levels read only these), and for the result.  Each is one aggregate combined before the shuffle, so a source or
a repeated row with a third of all rows is no larger than any other after combining.  Equal rows at an edge are
numbered by the files of their own table, whose rows are bounded: counts by file are added up, and only the rows of one
file are put in order.  The tables of budgets have a row for each source and copy and are written, so their true size
decides whether they are broadcast.

Cases: null or empty text has size 0 and is taken 0; a null source is a source of its own; of rows equal in id and
text the number taken is fixed, which of them is not; very long texts are one row like others, so they may miss the
budget by half their size; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, scratch, written

LEVELS = 4
DIGITS = 3  # hex digits of the hash at each level
FILE_ROWS = 1_000_000  # rows of a file of equal rows: what one task puts in order


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``weight`` by the rank of ``source`` in code-point order, null last, repeating.  One row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(values, (rank % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``target`` for rows (source, source_size, weight): ``share`` of all sizes by weight, none above ``most`` sizes.

    Sources fill up in the order of size over weight, so the excess of the full ones, reshared until none is above, is
    one running sum in that order.  A size of 0 gets 0; no source with a positive weight and size is left out.
    """
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = sources.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", left / rest)
    # the first source that is not filled fixes the level of all that follow
    df = df.withColumn("open", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(F.least(level * F.col("weight"), F.col("cap")), F.col("cap"))
    return df.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column, *more: Column) -> Column:
    out = a.eqNullSafe(b)
    for c in more:
        out = out & c
    return out


def _edges(sums: DataFrame, label: str) -> DataFrame:
    """The piece in which each budget ends (``sums``: source, copy, budget, before, piece, size, n)."""
    run = Window.partitionBy("source", "copy").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.col("before") + F.sum("size").over(run))
    over = F.struct("piece", (F.col("upto") - F.col("size")).alias("before"), "size", "n")
    first = upto.filter(F.col("upto") > F.col("budget")).groupBy("source", "copy", "budget").agg(F.min_by(over, "piece").alias("x"))
    return written(
        first.select(
            F.col("source").alias("edge_source"), F.col("copy").alias("edge_copy"), "budget", F.col("x.piece").alias("edge"),
            F.col("x.before").alias("before"), F.col("x.size").alias("edge_size"), F.col("x.n").alias("edge_rows"),
        ),
        label,
    )


def thresholds(sized: DataFrame, pieces: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source and copy the hash below which documents are taken, the rows with just that hash, and how many of
    them are taken.

    ``sized``: source, size, hash.  ``pieces``: their sums (source, piece, size, n) by the first piece of the hash.
    ``budgets``: source, copy, budget, between 0 and the source's size.
    """
    wanted = budgets.withColumnRenamed("source", "edge_source")
    sums = pieces.join(wanted, F.col("source").eqNullSafe(F.col("edge_source"))).drop("edge_source")
    edge = _edges(sums.withColumn("before", F.lit(0).cast("long")), "mix-edge-1")
    inside = sized.join(edge, _same(F.col("source"), F.col("edge_source"), F.col("hash").startswith(F.col("edge"))))
    rest = inside.groupBy("source", F.col("edge_copy").alias("copy"), "hash").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    rest = written(rest, "mix-boundary")
    for level in range(2, LEVELS + 1):
        here = _same(F.col("source"), F.col("edge_source"), F.col("copy") == F.col("edge_copy"), F.col("hash").startswith(F.col("edge")))
        piece = F.substring("hash", 1, DIGITS * level).alias("piece")
        sums = rest.join(edge, here).groupBy("source", "copy", "budget", "before", piece)
        edge = _edges(sums.agg(F.sum("size").alias("size"), F.sum("n").alias("n")), f"mix-edge-{level}")
    one = F.col("edge_size").cast("double") / F.col("edge_rows")
    near = F.ceil(((F.col("budget") - F.col("before")) * 2 - one) / (one * 2))
    return edge.withColumn("edge_taken", F.least(F.col("edge_rows"), F.greatest(F.lit(0), near)).cast("long"))


def row_hash() -> Column:
    """48 bits (12 hex digits) of md5 over id and text."""
    whole = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.substring(F.md5(whole), 1, DIGITS * LEVELS)


def plan_mix(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """One row for each source: its size, target, and the edge of each copy (``sized``: source, size, hash)."""
    piece = F.substring("hash", 1, DIGITS).alias("piece")
    pieces = written(sized.groupBy("source", piece).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-pieces")
    sums = written(pieces.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goal = written(targets(cyclic_weights(sums, weights), share, most), "mix-targets")
    copy = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy")
    budgets = goal.select("source", "source_size", "target", copy)
    budgets = budgets.select("source", "copy", "source_size", (F.col("target") - F.col("copy") * F.col("source_size")).alias("budget"))
    budgets = budgets.filter((F.col("budget") > 0) & (F.col("budget") < F.col("source_size"))).drop("source_size")
    edges = thresholds(sized, pieces, budgets)
    out = goal.withColumnRenamed("source", "mix_source")
    for k in range(most):
        edge = edges.filter(F.col("edge_copy") == k).select(
            F.col("edge_source").alias(f"s{k}"), F.col("edge").alias(f"k{k}_hash"), F.col("edge_rows").alias(f"k{k}_rows"), F.col("edge_taken").alias(f"k{k}_taken")
        )
        out = out.join(edge, F.col("mix_source").eqNullSafe(F.col(f"s{k}")), "left").drop(f"s{k}")
    return written(out, "mix-plan")


def _parts_equal_rows(k: int) -> Column:
    """Whether the edge of copy ``k`` takes some but not all rows of one hash."""
    return F.coalesce((F.col(f"k{k}_taken") > 0) & (F.col(f"k{k}_taken") < F.col(f"k{k}_rows")), F.lit(False))


def numbered(joined: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Rows (``mix_hash`` and their source's plan) with ``mix_rank``: their number among equal rows at an edge, else null."""
    unranked = F.lit(None).cast("long").alias("mix_rank")
    parted = F.lit(False)
    for k in range(most):
        parted = parted | _parts_equal_rows(k)
    if plan.filter(parted).isEmpty():
        return joined.select("*", unranked)
    apart = F.lit(False)
    for k in range(most):
        apart = apart | (_parts_equal_rows(k) & (F.col("mix_hash") == F.col(f"k{k}_hash")))
    spark, path = joined.sparkSession, scratch(joined.sparkSession, "mix-equal")
    joined.filter(apart).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    tied = spark.read.schema(joined.schema).parquet(path)
    tied = tied.select("*", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_at"))
    key = ("mix_source", "mix_hash")
    files = tied.groupBy(*key, "mix_file").agg(F.count(F.lit(1)).alias("mix_n"))
    before = F.sum("mix_n").over(Window.partitionBy(*key).orderBy("mix_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("mix_source").alias("s"), F.col("mix_hash").alias("h"), F.col("mix_file").alias("f"), F.coalesce(before, F.lit(0)).alias("mix_before"))
    tied = tied.join(files, _same(F.col("mix_source"), F.col("s"), F.col("mix_hash") == F.col("h"), F.col("mix_file") == F.col("f")))
    place = F.row_number().over(Window.partitionBy(*key, "mix_file").orderBy("mix_at"))
    ranked = tied.select(*joined.columns, (F.col("mix_before") + place).cast("long").alias("mix_rank"))
    return joined.filter(~apart).select("*", unranked).union(ranked)


def copies(most: int) -> Column:
    """Copies of a row of ``numbered``: copy k covers the target between k and k + 1 sizes."""
    total = F.lit(0)
    for k in range(most):
        whole = F.col("target") - k * F.col("source_size") >= F.col("source_size")
        edge, taken = F.col(f"k{k}_hash"), F.col(f"k{k}_taken")
        at_edge = (taken >= F.col(f"k{k}_rows")) | F.coalesce(F.col("mix_rank") <= taken, F.lit(False))
        below = (F.col("mix_hash") < edge) | ((F.col("mix_hash") == edge) & at_edge)
        total = total + F.when(whole | F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return total


def mix(docs: DataFrame, *, weights: Sequence[float], share: float, most: int = 2) -> DataFrame:
    """Each document's ``doc_id`` with ``size``, ``source_size``, ``target`` and ``taken`` (size times copies)."""
    source = F.col("source").cast("string").alias("source")
    sized = written(docs.select("doc_id", source, word_count("text").alias("size"), row_hash().alias("hash")), "mix-sizes")
    plan = plan_mix(sized.select("source", "size", "hash"), weights, share, most)
    joined = sized.withColumnRenamed("hash", "mix_hash").join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
    taken = (F.col("size") * copies(most)).cast("long").alias("taken")
    return numbered(joined, plan, most).select("doc_id", "size", "source_size", "target", taken)


def mixed(docs: DataFrame, *, weights: Sequence[float], share: float, most: int = 2) -> DataFrame:
    """The documents of the mix with all their columns; a document with two copies is there twice."""
    source = F.col("source").cast("string").alias("source")
    sized = written(docs.select(source, word_count("text").alias("size"), row_hash().alias("hash")), "mix-sizes")
    plan = plan_mix(sized, weights, share, most)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("mix_row")
    rows = docs.select(whole, docs["source"].cast("string").alias("mix_own"), row_hash().alias("mix_hash"))
    joined = rows.join(plan, F.col("mix_own").eqNullSafe(F.col("mix_source")))
    many = numbered(joined, plan, most).select("mix_row", F.explode(F.array_repeat(F.lit(1), copies(most))))
    return many.select("mix_row.*")
