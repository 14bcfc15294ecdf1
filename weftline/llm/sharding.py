"""Bounded-load consistent hashing of rows onto shards.

A ring of ``shards * points`` virtual nodes cuts the hash space into arcs; an arc belongs to the shard of the node at
its clockwise end.  A shard holds at most its capacity.  Arcs are visited clockwise from 0: the owner takes the arc's
own keys first, then those carried along from full shards before it; what does not fit is carried on.  After the first
lap only carried keys remain, and they find the shards with room left on the second.  With no slack, capacities are
the exact shares (counts differ by one at most); with slack fewer keys leave their arc.

Only the number of keys on each arc decides where the edges lie: ``shards * points`` numbers (a parameter, not the
data) come to the driver, and a table of at most a few intervals for each arc goes back, joined to the rows by arc.
The rows of an arc are numbered by their place on the ring, then by a hash of all their columns: what a row gets follows
from the rows alone, not from files, partitions or sizes.  Only rows equal in all columns are told apart by their position in
a written table, and they are interchangeable.  While the largest arc has at most ``CELL_ROWS`` rows, an arc is one window; beyond that a range
shuffle by the same order cuts all arcs into even parts, so an id that a third of all rows share fills many of them.

Cases: null ids are keys like any other (rows of one id stand side by side on one arc; the edge of a full shard may fall
between them); null text is empty; a very long text is only measured and hashed; repeated rows are counted one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written
from weftline.plans.ordered import Line
from weftline.plans.sizing import GroupSizes

CELL_ROWS = 100_000


def _node(shard: int, point: int) -> int:
    """Place of a virtual node on a ring of 2^32 (public splitmix64 finaliser)."""
    x = (shard * 1_000_003 + point + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return (x ^ x >> 31) >> 32


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in clockwise order."""
    return sorted((_node(s, p), s) for s in range(shards) for p in range(points))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot) for the keys from … to - 1 of each arc; ``counts`` by arc."""
    room, filled = list(capacity), [0] * len(capacity)
    out: list[tuple[int, int, int, int, int]] = []
    carried: list[tuple[int, int, int]] = []
    for lap in range(2):
        for arc, owner in enumerate(owners):
            waiting = ([(arc, 0, counts[arc])] if lap == 0 and counts[arc] else []) + carried
            carried = []
            for origin, lo, hi in waiting:
                fit = min(hi - lo, room[owner])
                if fit:
                    out.append((origin, lo, lo + fit, owner, filled[owner]))
                    room[owner] -= fit
                    filled[owner] += fit
                if lo + fit < hi:
                    carried.append((origin, lo + fit, hi))
    if carried:
        raise ValueError("the capacities are smaller than the number of keys")
    return out


def arc_of(places: list[int], place: Column) -> Column:
    """Index of the arc that holds a place: the first node at or after it, else the first of all."""
    n = len(places)
    # a table by the upper 12 bits narrows the search to a short slice of the ring
    starts = [bisect.bisect_left(places, k << 20) for k in range(4097)]
    table, upto = F.lit(starts[:-1]), F.lit(starts[1:])
    k = (F.shiftright(place, 20) + 1).cast("int")
    lo = F.element_at(table, k)
    inner = F.slice(F.lit(places), lo + 1, F.element_at(upto, k) - lo)
    arc = lo + F.size(F.filter(inner, lambda x: x < place))
    return (arc % n).cast("int")


def on_ring(rows: DataFrame, key: str, *, shards: int, points: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``rows`` is written once, so leave wide columns out and join them by key afterwards where they are needed.
    """
    nodes = ring(shards, points)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    place = F.crc32(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    names = rows.columns
    told = F.xxhash64(*[rows[c] for c in names], *[rows[c].isNull() for c in names])
    packed = rows.select(F.struct(*[rows[c] for c in names]).alias("row"), place.alias("place"), told.alias("hash"))
    table = written(packed.select("row", "place", "hash", arc_of(places, F.col("place")).alias("arc")), "ring-keys")
    counted = {r["arc"]: r["n"] for r in table.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [counted.get(a, 0) for a in range(len(nodes))]
    spark = rows.sparkSession
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, lo, hi, shard, slot in deal(counts, owners, capacities(sum(counts), shards, slack)):
        runs.setdefault(arc, []).append((lo, hi, shard, slot))
    plan = spark.createDataFrame(
        list(runs.items()), "plan_arc int, runs array<struct<lo: long, hi: long, shard: int, slot: long>>"
    )
    # file and position of a written row never change
    tie = {"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")}
    placed = table.select("row", "arc", "place", "hash", *[c.alias(n) for n, c in tie.items()])
    sizes = GroupSizes(sum(counts), len(counted), max(counts))
    line = Line.of(placed, "arc", ["place", "hash", *tie], CELL_ROWS, sizes).with_position("rank")
    ranked = line.result().select("row", "arc", "rank")
    joined = ranked.join(F.broadcast(plan), F.col("arc") == F.col("plan_arc"))  # shards * points rows at most
    run = F.filter("runs", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    out = joined.select("row", "rank", run.alias("run"))
    return out.select("row.*", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.lo")).alias("slot"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8) and crc32 of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def shard_documents(docs: DataFrame, *, shards: int, points: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``: counts differ by one at most), shard, slot, grown_shard (null)."""
    out = on_ring(sized(docs), "doc_id", shards=shards, points=points)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
