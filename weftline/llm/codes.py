"""Vector codes: each vector is cut into parts, and each part becomes the index of the nearest entry of a codebook.

Components are whole numbers (1024ths, rounded down), so distances, sums and codebooks are exact, and the same for any
partitioning.  The codebooks are trained on all parts.

Training.  Equal parts are counted before anything else, so a part that a third of all rows share is one row.  The
distinct parts lie in lexicographic order in the files of a table, and each round reads that table once.  A task forms
the trie of a batch of parts and walks it depth first: a node holds the squared distances of its prefix to all entries,
and each child adds one dimension to them.  A leaf takes the nearest entry and adds its part, times its count, to the sums
of that entry.  Sums of tasks are added up by Spark; what comes back to the driver is a row per entry (1,024 of them).

Codes.  Every row is coded in its own batch by the same walk over the batch's distinct parts; errors of equal labels are
summed before they are joined back.

Null vectors, and vectors with a null or non-finite component, are left out; null ids and labels are values like others
(null ids come last where the smallest are taken).  Rows of one id stand side by side; among them the smaller vector comes first.
With fewer than 256 rows the codebook has as many entries; equal entries are kept, and the first of them is used.  An
empty table gives an empty one.  Vectors of different lengths, a length that the parts don't divide, and components whose
squares could leave 64 bits (beyond 180,000 for 16 components a part) are refused.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, written
from weftline.llm.vectors import lists, matrix, sound, width_of
from weftline.plans.joining import join_null_safe

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4

#: Parts of a batch whose distances are held side by side: 256 rows of 256 whole numbers are half a megabyte.
FAN = 256


class Trie:
    """The prefixes of lexicographically sorted distinct rows, walked depth first with distances to the entries of a book.

    ``shared[i]`` is the number of leading dimensions that rows ``i - 1`` and ``i`` have in common: a row starts a new
    node at each depth from there on.
    """

    def __init__(self, rows: np.ndarray, entries: np.ndarray) -> None:
        self.rows, self.entries = rows, np.ascontiguousarray(entries.T)
        n, self.depth = rows.shape
        differs = np.ones((n, self.depth + 1), bool)
        differs[1:, : self.depth] = rows[1:] != rows[:-1]
        differs[0, 0] = True
        self.shared = differs.argmax(1)
        self.shared[:1] = 0
        self.nearest = np.zeros(n, np.int64)
        self.distance = np.zeros(n, np.int64)

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the first of equally near ones) and squared distance of each row."""
        if len(self.rows):
            self._node(0, len(self.rows), 0, np.zeros(self.entries.shape[1], np.int64))
        return self.nearest, self.distance

    def _step(self, value: np.ndarray, depth: int) -> np.ndarray:
        away = value[:, None] - self.entries[depth][None, :]
        return away * away

    def _node(self, lo: int, hi: int, depth: int, upto: np.ndarray) -> None:
        """All rows below one node.  Children with few rows are walked together, others one by one."""
        if hi - lo <= FAN or depth == self.depth:
            self._fan(lo, hi, depth, upto)
            return
        first = lo + np.concatenate([np.zeros(1, np.int64), np.flatnonzero(self.shared[lo + 1 : hi] <= depth) + 1])
        ends = np.append(first[1:], hi)
        i = 0
        while i < len(first):
            j = max(int(np.searchsorted(ends, first[i] + FAN, "right")), i + 1)
            a, b = int(first[i]), int(ends[j - 1])
            if j == i + 1 and b - a > FAN:
                self._node(a, b, depth + 1, upto + self._step(self.rows[a : a + 1, depth], depth)[0])
            else:
                self._fan(a, b, depth, upto)
            i = j

    def _fan(self, lo: int, hi: int, depth: int, upto: np.ndarray) -> None:
        """The levels below a node, each node of a level once; the leaves take their minimum."""
        held = upto[None, :]
        at = np.zeros(hi - lo, np.int64)  # the node each row hangs on
        heads = np.zeros(1, np.int64)
        for d in range(depth, self.depth):
            if len(heads) < hi - lo:
                starts = self.shared[lo:hi] <= d
                starts[0] = True
                heads = np.flatnonzero(starts)
                parent = at[heads]
                at = np.cumsum(starts) - 1
                held = held[parent] + self._step(self.rows[lo + heads, d], d)
            else:
                held += self._step(self.rows[lo:hi, d], d)
        best = held.argmin(1)
        self.nearest[lo:hi] = best[at]
        self.distance[lo:hi] = held[np.arange(len(held)), best][at]


def whole_numbers(vectors: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """Kept rows with ``q``, the components in ``SCALE``-ths rounded down, and the length of a part (0 without a row)."""
    kept = vectors.filter(sound(F.col(vector)))
    width = width_of(kept, vector)
    if width is None:
        return kept.withColumn("q", F.lit(None).cast("array<bigint>")), 0
    if width % parts:
        raise ValueError(f"{width} components are no {parts} equal parts")
    length = width // parts
    limit = int((2.0**62 / max(length, 1)) ** 0.5 / 2)
    q = F.transform(F.col(vector).cast("array<double>"), lambda x: _floor(x, limit))
    return kept.withColumn("q", q), length


def _floor(x, limit: int):
    scaled = F.floor(x * F.lit(float(SCALE)))
    too_far = F.raise_error(F.lit(f"a component is beyond {limit} / {SCALE}; its squares could leave 64 bits"))
    return F.when(F.abs(x) * SCALE < limit, scaled).otherwise(too_far.cast("bigint"))


def _part(q, position: int, length: int):
    return F.slice(q, position * length + 1, length)


def distinct_parts(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """Each distinct part with its position and number, in lexicographic order within and over files."""
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), _part(F.col("q"), p, length).alias("part")) for p in range(parts)]))
    counted = rows.select(one.alias("o")).select("o.*").groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part")
    return written(ordered, "codes-parts")


def first_entries(rows: DataFrame, id: str, parts: int, length: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids: at most ``entries`` rows come back."""
    few = rows.select(id, "q").orderBy(F.asc_nulls_last(id), "q").limit(entries).collect()
    book = np.array([r["q"] for r in few], np.int64).reshape(len(few), parts * length)
    return [book[:, p * length : (p + 1) * length].copy() for p in range(parts)]


def _by_position(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, rows and counts of the parts of a batch, which may span positions."""
    position = batch.column("position").to_numpy()
    rows, n = matrix(batch.column("part"), length, np.int64), batch.column("n").to_numpy()
    for p in np.unique(position):
        mine = position == p
        yield int(p), rows[mine], n[mine]


def train(parts: DataFrame, books: Sequence[np.ndarray], length: int, rounds: int) -> list[np.ndarray]:
    """Rounds of assigning all parts and replacing each used entry by the mean of its parts, rounded down."""
    books = list(books)
    for _ in range(rounds):

        def sums(batch: pa.RecordBatch, books=tuple(books)) -> Iterator[dict]:
            for p, rows, n in _by_position(batch, length):
                nearest, _ = Trie(rows, books[p]).walk()
                used, to = np.unique(nearest, return_inverse=True)
                count, total = np.zeros(len(used), np.int64), np.zeros((len(used), length), np.int64)
                np.add.at(count, to, n)
                np.add.at(total, to, rows * n[:, None])
                yield {"position": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used), "n": pa.array(count), "total": lists(total)}

        found = map_arrow(parts, sums, "position int, entry bigint, n bigint, total array<bigint>")
        total = F.array(*[F.sum(F.col("total")[d]) for d in range(length)]) if length else F.lit(None).cast("array<bigint>")
        books = [b.copy() for b in books]
        for r in found.groupBy("position", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
            if length:
                books[r["position"]][r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return books


def book_digest(books: Sequence[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: Sequence[np.ndarray], length: int, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of each row with ``entries`` (indexes by part) and ``error`` (squared distances, summed)."""
    parts = len(books)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        q = matrix(batch.column("q"), parts * length, np.int64)
        entries, error = np.zeros((len(q), parts), np.int64), np.zeros(len(q), np.int64)
        for p, book in enumerate(books):
            mine = np.ascontiguousarray(q[:, p * length : (p + 1) * length])
            distinct, back = np.unique(mine, axis=0, return_inverse=True) if length else (mine[:1], np.zeros(len(mine), np.int64))
            nearest, distance = Trie(distinct, book).walk()
            entries[:, p] = nearest[back.reshape(-1)]
            error += distance[back.reshape(-1)]
        yield {c: batch.column(c) for c in keep} | {"entries": lists(entries), "error": pa.array(error)}

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows.select(*keep, "q"), work, f"{kept}, entries array<bigint>, error bigint")


def quantize(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Each kept row's id, label, indexes by part and error, and the codebooks (one array of entries a part)."""
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kept, length = whole_numbers(rows, "vector", parts)
    kept = kept.select("vec_id", "label", "q")
    books = first_entries(kept, "vec_id", parts, length, entries)
    if len(books[0]):
        books = train(distinct_parts(kept, parts, length), books, length, rounds)
    return written(coded(kept, books, length, ["vec_id", "label"]), "codes"), books


def report(vectors: DataFrame) -> DataFrame:
    """Code, error, error of the label's rows together, and the digest of the codebooks."""
    rows, books = quantize(vectors)
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("entries")[p]), 2, "0")) for p in range(PARTS)])
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_null_safe(rows, errors, ["label"], "inner")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
