"""Connected components of a link table by alternating stars.

Links point from a larger to a smaller id.  A round turns every node's larger neighbours to the smallest id it knows
(large star) and then its smaller neighbours and itself (small star), until nothing changes; each node then points at
the smallest id of its component.  The minima of a node are combined before the shuffle and written, so the joins
around a node with very many links are plain ones that adaptive execution can split.  Nothing comes to the driver
but the number and checksum of the links after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def _print(links: DataFrame) -> tuple[int, int]:
    # links are distinct, so xor tells sets of them apart; unlike a sum it can't overflow
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("s")).first()
    return row["n"], row["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest id reachable) for each id that is linked to a smaller one.

    ``links`` has two columns of ids; repeated links, either order and links to oneself are allowed.
    """
    a, b = (F.col(c) for c in links.columns)
    pairs = links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = written(pairs, "links")
    seen = _print(now)
    while seen[0]:
        low = now.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        least = written(low, "links-min")
        # large star: the larger neighbours of lo turn to the smallest neighbour of lo, or to lo itself
        joined = now.join(least, F.col("lo") == F.col("u"), "left")
        large = written(joined.select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "links-large")
        # small star: the smaller neighbours of hi, and hi, turn to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        least = written(low, "links-min")
        other = large.join(least, F.col("hi") == F.col("u")).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(other.union(least.select("u", "m")).distinct(), "links-small")
        was, seen = seen, _print(now)
        if was == seen:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
