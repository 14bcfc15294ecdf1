"""Nearest vectors by inner product: stable projections, a kd-tree over them, and verification until a chi-square test holds.

Largest inner product becomes smallest distance by one more component that gives all rows the length of the longest one
(0 for a query, which is scaled to that length).  A Gaussian projection to ``dims`` dimensions multiplies a squared
distance by a chi-square variable.  So if a query's k-th best verified distance is ``d``, a row that is really nearer lies
within ``sqrt(chi2(certainty)) * d`` of it in the projection with at least that certainty; once all rows so near in the
projection are verified, the search stops.

On Spark.  Equal vectors are one entry with the smallest ids that any query could return (grouped before anything else,
so a vector that a third of all rows share is one entry).  The upper kd-tree is fitted on a bounded sample of entries; all
entries go to its cells, and a cell that turns out larger than ``cell`` is dealt to several groups of that size by a hash.
A query first meets its own cell, which gives it a bound, then every other cell whose box in the projection is near enough for that bound.
A task holds one group of entries with a kd-tree of its own, and reads the queries that meet it in batches: a batch
takes the leaves of each query in the order of their projected distance, verifies them by matrix products, and drops a
query when the test holds for its next leaf.  So memory is bounded by a group and a batch; no candidate is cut off.

Scores of the answers are sums in the order of the components, in double precision, so equal vectors tie exactly.  Null and
zero vectors and those with a null or non-finite component take no part; vectors of different lengths are refused.
Rows with a null id are candidates (last among ties), never queries.  A query is an id with its vector: rows that repeat both are
one query, and of them only one is left out as its own row.  An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, written
from weftline.llm.vectors import matrix, sound, width_of

DIMS = 8
CERTAINTY = 0.97
K = 20
EVERY = 20
CELL, LEAF = 4096, 128
SAMPLE = 16_384
SEED = 42
#: Batch of queries that are worked on together.
TOGETHER = 1024

NO_ID = 2**63 - 1


def chi_square(certainty: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of dimensions lies with that probability."""
    if dims % 2 or not 0 < certainty < 1:
        raise ValueError("an even number of dimensions and a certainty between 0 and 1 are asked for")

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, float(dims)
    while below(hi) < certainty:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < certainty else (lo, mid)
    return hi


class Space(NamedTuple):
    """The projection, and the length that all rows are brought to."""

    gauss: np.ndarray
    longest: float

    @classmethod
    def of(cls, width: int, dims: int, longest: float, seed: int) -> Space:
        return cls(np.random.default_rng(seed).standard_normal((width + 1, dims)), longest)

    def entries(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows with their additional component."""
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0.0))
        return x @ self.gauss[:-1] + rest[:, None] * self.gauss[-1]

    def scale(self, q: np.ndarray) -> np.ndarray:
        return self.longest / np.sqrt(np.einsum("ij,ij->i", q, q))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q @ self.gauss[:-1]) * self.scale(q)[:, None]


class Boxes(NamedTuple):
    """Cells of a kd-tree: lower and upper corner of each (infinite at the outside), and the splits that lead to them.

    ``child`` is a node, or ``-1 - cell``; a value below the split goes to the first child.
    """

    low: np.ndarray
    high: np.ndarray
    dim: np.ndarray
    split: np.ndarray
    child: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Boxes:
        """Median splits of a sample along its widest dimension, until there are so many cells (or one value is left)."""
        dims = points.shape[1]
        low, high, dim, split, child = [], [], [], [], []

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: int) -> int:
            if wanted > 1 and len(rows) > 1:
                part = points[rows]
                d = int(np.argmax(part.max(0) - part.min(0)))
                first = wanted // 2
                cut = np.sort(part[:, d])[min(max(len(rows) * first // wanted, 1), len(rows) - 1)]
                below = part[:, d] < cut
                if below.any():
                    at = len(dim)
                    dim.append(d)
                    split.append(cut)
                    child.append([0, 0])
                    up, down = hi.copy(), lo.copy()
                    up[d] = down[d] = cut
                    child[at][0] = grow(rows[below], lo, up, first)
                    child[at][1] = grow(rows[~below], down, hi, wanted - first)
                    return at
            low.append(lo)
            high.append(hi)
            return -len(low)

        root = grow(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf), cells)
        if root < 0:
            dim, split, child = [0], [np.inf], [[root, root]]
        return cls(np.array(low), np.array(high), np.array(dim), np.array(split), np.array(child))

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while (open_ := node >= 0).any():
            here = node[open_]
            side = (points[open_, self.dim[here]] >= self.split[here]).astype(np.int64)
            node[open_] = self.child[here, side]
        return -1 - node

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each box."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        away = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0.0)
        out += away * away
    return out


class Group:
    """Entries of a task with their kd-tree: rows in leaf order, tight boxes of the leaves."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray], space: Space, leaf: int) -> None:
        at = space.entries(x)
        order, starts = [], [0]
        todo = [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf:
                part = at[rows]
                d = int(np.argmax(part.max(0) - part.min(0)))
                half = len(rows) // 2
                by = np.argpartition(part[:, d], half)
                todo += [rows[by[half:]], rows[by[:half]]]
                continue
            order.append(rows)
            starts.append(starts[-1] + len(rows))
        self.order = np.concatenate(order)
        self.starts = np.array(starts)
        self.x, at = x[self.order], at[self.order]
        self.ids = [ids[i] for i in self.order]
        cuts = self.starts[:-1]
        self.low, self.high = np.minimum.reduceat(at, cuts), np.maximum.reduceat(at, cuts)
        self.copies = np.array([len(i) for i in self.ids])
        self.space = space
        self.verified = 0  # pairs so far

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, chi: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of all verified pairs that may be among the ``k`` nearest, by query.

        ``bound`` is an inner product that ``k`` candidates elsewhere are known to reach (or -inf); here it rises with
        what is verified.
        """
        scale, slack = self.space.scale(q), self._slack(q)
        away = box_distances(self.space.queries(q), self.low, self.high)
        by = np.argsort(away, axis=1, kind="stable")
        best = np.full((len(q), k + 1), -np.inf)  # one more, as a query may meet itself
        bound = bound.copy()
        copies = np.minimum(self.copies, k + 1)
        found = []
        live = np.arange(len(q))
        for turn in range(by.shape[1]):
            leaf = by[live, turn]
            # the squared distance at which the k-th verified row stands, by its inner product
            reach = 2 * self.space.longest * (self.space.longest - bound[live] * scale[live] / self.space.longest)
            near = away[live, leaf] <= chi * np.maximum(reach, 0.0) + 1e-9 * self.space.longest**2
            live, leaf = live[near], leaf[near]
            if not len(live):
                break
            deal = np.argsort(leaf, kind="stable")
            begin = 0
            for end in np.append(np.flatnonzero(np.diff(leaf[deal])) + 1, len(deal)):
                who, at = live[deal[begin:end]], leaf[deal[begin]]
                begin = end
                a, b = self.starts[at], self.starts[at + 1]
                score = q[who] @ self.x[a:b].T
                self.verified += score.size
                rows, cols = np.nonzero(score >= (bound[who] - slack[who])[:, None])
                if not len(rows):
                    continue
                found.append((who[rows], a + cols, score[rows, cols]))
                counted = np.repeat(score, copies[a:b], axis=1) if (copies[a:b] > 1).any() else score
                both = np.concatenate([best[who], counted], axis=1)
                best[who] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                bound[who] = np.maximum(bound[who], best[who].min(1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = score >= bound[who] - slack[who]
        who, row = who[kept], row[kept]
        order = np.argsort(who, kind="stable")
        return who[order], row[order]

    def _slack(self, q: np.ndarray) -> np.ndarray:
        """What products of the same numbers in another order can differ by."""
        return 1e-12 * self.space.longest * np.sqrt(np.einsum("ij,ij->i", q, q))


def ordered_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _answers(group: Group, q: np.ndarray, ids: np.ndarray, keys: np.ndarray, bound: np.ndarray, k: int, chi: float) -> dict | None:
    """At most ``k`` candidates of each query in one group, by score and id, without the query's own row."""
    who, row = group.search(q, bound, k, chi)
    if not len(who):
        return None
    score = ordered_sum(q[who], group.x[row])
    copies = group.copies[row]
    candidate = np.concatenate([group.ids[i] for i in row])
    who, row, score = (np.repeat(x, copies) for x in (who, row, score))
    # a query's own row: its id in the entry of its vector, once
    own = candidate == ids[who]
    own[own] = (group.x[row[own]] == q[who[own]]).all(1)
    again = np.zeros(len(own), bool)
    again[1:] = own[1:] & own[:-1] & (who[1:] == who[:-1]) & (row[1:] == row[:-1])
    kept = ~(own & ~again)
    who, score, candidate = who[kept], score[kept], candidate[kept]
    order = np.lexsort((candidate, -score, who))
    who, score, candidate = who[order], score[order], candidate[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    who, score, candidate = who[rank < k], score[rank < k], candidate[rank < k]
    return {"query_id": pa.array(ids[who]), "key": pa.array(keys[who]), "vec_id": pa.array(candidate), "score": pa.array(score)}


ANSWERS = "query_id bigint, key bigint, vec_id bigint, score double"
PLACE = ["cell", "chunk"]


def _met(entries: DataFrame, queries: DataFrame, space: Space, k: int, chi: float, leaf: int) -> DataFrame:
    """Answers of all groups: entries (cell, chunk, vector, ids) and the queries that meet them (… query_id, key, bound).

    Both are dealt by group and sorted, entries first, so a task reads one group at a time and its queries in batches.
    """
    none = {"ids": "array<bigint>", "query_id": "bigint", "key": "bigint", "bound": "double"}
    columns = [*PLACE, "kind", "vector", *none]

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        missing = {c: F.lit(None).cast(t) for c, t in none.items() if c not in df.columns}
        return df.withColumns({"kind": F.lit(kind), **missing}).select(*columns)

    both = shaped(entries, 0).unionByName(shaped(queries, 1))
    both = both.repartition(*PLACE).sortWithinPartitions(*PLACE, "kind")
    width = len(space.gauss) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group, held, held_ids = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, chunk, kind = (batch.column(c).to_numpy() for c in (*PLACE, "kind"))
            changes = (np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0)
            starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(changes) + 1])
            for a, b in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                x = matrix(batch.column("vector").slice(a, b - a), width)
                if (cell[a], chunk[a]) != place:
                    place, group, held, held_ids = (cell[a], chunk[a]), None, [], []
                if kind[a] == 0:
                    held.append(x)
                    ids = batch.column("ids").slice(a, b - a)
                    sizes = ids.value_lengths().to_numpy()
                    held_ids += np.split(ids.flatten().to_numpy(), np.cumsum(sizes)[:-1])
                    continue
                if group is None:
                    if not held:
                        continue
                    group = Group(np.concatenate(held), held_ids, space, leaf)
                    held, held_ids = [], []
                ids, keys, bound = (batch.column(c).slice(a, b - a).to_numpy() for c in ("query_id", "key", "bound"))
                for i in range(0, len(x), TOGETHER):
                    part = slice(i, i + TOGETHER)
                    out = _answers(group, x[part], ids[part], keys[part], bound[part], k, chi)
                    if out:
                        yield pa.RecordBatch.from_pydict(out)

    return both.mapInArrow(run, ANSWERS)


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The ``k`` best answers of each query with their rank; the limit works before the shuffle too."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    every: int = EVERY,
    k: int = K,
    dims: int = DIMS,
    certainty: float = CERTAINTY,
    cell: int = CELL,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id ``every`` divides: query_id, rank, vec_id, score.

    ``certainty`` is the least probability with which a true neighbour is found; ``sample`` bounds about the entries the
    upper tree is fitted on.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    chi = chi_square(certainty, dims)
    x = F.col(vector)
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), x.alias("vector")).filter(sound(x) & F.exists(x, lambda c: c != 0))
    width = width_of(rows, "vector")
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)

    # equal vectors: one entry with the k + 1 smallest ids (one of them may be the query)
    ranked = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    ranked = ranked.withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= k + 1)
    entries = written(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "srs-entries")

    square = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c)
    sizes = entries.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).first()
    space = Space.of(width, dims, math.sqrt(sizes["most"]) * (1 + 1e-12), seed)
    share = 1 << 30
    some = F.pmod(F.xxhash64("vector"), F.lit(share)) < max(int(share * min(1.0, sample / sizes["n"])), 1)
    drawn = matrix(entries.filter(some).select("vector").toArrow().column(0).combine_chunks(), width)
    boxes = Boxes.fit(space.entries(drawn), min(-(-sizes["n"] // cell), max(sample // 8, 1)))

    def to_cell(batch: pa.RecordBatch) -> Iterator[dict]:
        at = boxes.cell(space.entries(matrix(batch.column("vector"), width)))
        yield {c: batch.column(c) for c in batch.schema.names} | {"cell": pa.array(at, pa.int32())}

    def schema_of(df: DataFrame) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    placed = written(map_arrow(entries, to_cell, f"{schema_of(entries)}, cell int"), "srs-cells")
    counts = placed.groupBy("cell").count().collect()  # a row per cell; their number is bounded by the sample
    chunks = np.ones(len(boxes.low), np.int64)
    for r in counts:
        chunks[r["cell"]] = -(-r["count"] // cell)
    number = F.lit([int(c) for c in chunks])
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("vector", F.lit(1)), number[F.col("cell")]).cast("int"))

    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("key"), "vector")

    def visits(home: bool):
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            q = matrix(batch.column("vector"), width)
            for i in range(0, len(q), TOGETHER):
                part = q[i : i + TOGETHER]
                at = space.queries(part)
                bound = batch.column("bound").slice(i, len(part)).to_numpy(zero_copy_only=False)
                own = boxes.cell(at)
                if home:
                    who, to = np.arange(len(part)), own
                else:
                    reach = 2 * space.longest * (space.longest - bound * space.scale(part) / space.longest)
                    near = boxes.distances(at) <= (chi * np.maximum(reach, 0.0) + 1e-9 * space.longest**2)[:, None]
                    near[np.arange(len(part)), own] = False
                    who, to = np.nonzero(near)
                each = chunks[to]
                chunk = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                taken = pa.array(np.repeat(who, each) + i)
                yield {c: batch.column(c).take(taken) for c in batch.schema.names} | {
                    "cell": pa.array(np.repeat(to, each), pa.int32()),
                    "chunk": pa.array(chunk, pa.int32()),
                }

        return work

    def sent(queries: DataFrame, home: bool) -> DataFrame:
        return map_arrow(queries, visits(home), f"{schema_of(queries)}, cell int, chunk int")

    asked = written(asked, "srs-queries")
    first = written(_met(dealt, sent(asked.withColumn("bound", F.lit(float("-inf"))), True), space, k, chi, leaf), "srs-home")
    answers = first
    if len(boxes.low) > 1:
        known = _best(first, k).groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        bound = F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf"))
        bounded = asked.join(known, ["query_id", "key"], "left").select(*asked.columns, bound.alias("bound"))
        answers = first.unionByName(_met(dealt, sent(bounded, False), space, k, chi, leaf))
    best = _best(answers, k)
    return best.select("query_id", F.col("rank").cast("int"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
