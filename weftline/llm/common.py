"""Pieces that the training-data operators share: tables in the shared folder, and words of texts in numpy.

Texts reach Python in Arrow batches only.  A batch is worked on in pieces of about a megabyte, so memory follows the
piece (or one document, where a document is longer), not the batch or the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.sizing import shared_folder

U64 = np.uint64
PIECE_BYTES = 1 << 20
PIECE_DOCS = 4000
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in this session's folder below ``spark.checkpoint.dir``; the folder goes when the session's JVM ends."""
    top = f"{shared_folder(spark)}/weftline-llm-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder.

    This cuts the lineage (a lost executor costs a read, not the work before), keeps column pruning, and tells the
    optimizer the true size, so that it broadcasts only what is small.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` turns a batch into dicts of columns, one dict for each output batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + PIECE_DOCS)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of good avalanche (the constants are the public ones of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Alphabet(NamedTuple):
    """Which bytes make words, and the code of each byte (equal codes: the same letter)."""

    word: np.ndarray
    code: np.ndarray


def alphabet(separators: list[int], lower: bool) -> Alphabet:
    word = np.ones(256, bool)
    word[separators] = False
    fold = np.arange(256)
    if lower:
        fold[65:91] += 32
    return Alphabet(word, _BYTE_CODES[fold])


SPACES = [0x20, *range(0x09, 0x0E)]
PLAIN = alphabet(SPACES, lower=False)
LOWER = alphabet(SPACES, lower=True)
ALNUM = alphabet([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


class Words(NamedTuple):
    """Words of some documents in order: hash, first and last byte (exclusive), and where each document's words begin."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _prefix(data: np.ndarray, points: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Sum of code * base^position before each of the ascending points, block by block."""
    out = np.zeros(len(points), U64)
    before, lift = U64(0), U64(1)
    step = U64(pow(_BASE, _BLOCK, 1 << 64))
    for lo in range(0, len(data), _BLOCK):
        part = data[lo : lo + _BLOCK]
        run = np.empty(len(part) + 1, U64)
        run[0] = before
        np.cumsum(code[part] * _UP[: len(part)] * lift, out=run[1:])
        run[1:] += before
        a, b = np.searchsorted(points, (lo, lo + len(part)))
        out[a:b] = run[points[a:b] - lo]
        before, lift = run[-1], lift * step
    out[np.searchsorted(points, len(data)) :] = before
    return out


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (starts and ends ascending), from prefix sums."""
    with np.errstate(over="ignore"):
        value = _prefix(data, end, code) - _prefix(data, start, code)
        far = _powers(pow(_INVERSE, _BLOCK, 1 << 64), len(data) // _BLOCK + 2)
        return mix(value * _DOWN[start % _BLOCK] * far[start // _BLOCK] + (end - start).astype(U64))


def words(data: np.ndarray, cuts: np.ndarray, kind: Alphabet) -> Words:
    """Words of the documents that begin at ``cuts[:-1]`` and end at ``cuts[1:]``."""
    inside = kind.word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = cuts[:-1][cuts[:-1] < len(data)]
    opens[edge] = inside[edge]
    edge = cuts[1:][cuts[1:] > 0] - 1
    closes[edge] = inside[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(range_hashes(data, start, end, kind.code), start, end, np.searchsorted(start, cuts))


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes from each position on; the last n - 1 positions are left out."""
    if len(code) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(code) - n + 1, U64)
        for k in range(n):
            out = out * U64(_BASE) + code[k : k + len(out)]
        return mix(out)


def within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the positions 0 … total - n, those whose ``n`` words lie in one document."""
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total + 1, bool)
    lengths = np.diff(first)
    for k in range(1, n):  # the last n - 1 starts of each document reach into the next
        ends = first[1:][lengths >= k] - k
        ok[ends] = False
    return ok[: total - n + 1]


def cover(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """True where a range of ``length`` positions from one of ``starts`` lies."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, total), -1)
    return np.cumsum(step[:-1]) > 0
