"""Fill-in-middle: documents cut in three at token ends and put together with the middle last, and put back.

A batch of texts is worked on as bytes.  Token ends are found as bytes; what is said to the outside is counted in code
points.  Between the two stands a sparse index that knows only the characters of more than one byte: where they are, and
how many bytes they have in excess of one.  A binary search in it turns a byte cut into a code-point cut and back, and
between two such characters (all of an ASCII text) the two differ by a constant.

A token is a word with the white space before it, or the white space a text ends with.  Null and empty texts have no
token and stay plain.  A very long text is held whole, one at a time; others are worked on a megabyte at a time.  Repeated
rows, and rows of one id, are cut alike, as the cut follows the id; a null id counts as the empty text.  Columns of the
input other than the id and the text are not read, so their names can't clash.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import PIECE_BYTES, PLAIN, map_arrow, pieces, texts

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK_LETTERS = "PSM"

FORMS = ("plain", "psm", "spm")


class Wide(NamedTuple):
    """Index of the characters of several bytes: first byte, code point, and excess bytes up to and with each of them."""

    byte: np.ndarray
    point: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Wide:
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)])
        return cls(byte, byte - upto[:-1], upto)

    def to_points(self, cut: np.ndarray) -> np.ndarray:
        """Code points before byte cuts that lie between characters."""
        return cut - self.excess[np.searchsorted(self.byte, cut)]

    def to_bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before code-point cuts."""
        return cut + self.excess[np.searchsorted(self.point, cut)]


def draws(id: Column, seed: int, n: int) -> list[Column]:
    """``n`` (up to 8) whole numbers below 2^32 from the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


class Cuts(NamedTuple):
    """Of each document: units, byte cuts, and whether it holds a mark."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    marked: np.ndarray


def token_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> Cuts:
    """Cuts after a number of tokens that each of two draws leaves over ``n + 1``."""
    inside = PLAIN.word[data]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    full = ends > starts
    closes[ends[full] - 1] = inside[ends[full] - 1]
    after = np.flatnonzero(closes) + 1  # one byte behind each word
    base = np.searchsorted(after, starts, "right")
    words = np.searchsorted(after, ends, "right") - base
    n = words.copy()
    n[full] += ~inside[ends[full] - 1]
    low, high = _ordered(first, second, n)

    def place(units: np.ndarray) -> np.ndarray:
        out = np.where(units > words, ends, starts)
        at = (units > 0) & (units <= words)
        out[at] = after[base[at] + units[at] - 1]
        return out

    return Cuts(n, place(low), place(high), _marked(data, starts, ends))


def point_cuts(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, wide: Wide
) -> Cuts:
    """Cuts after a number of code points."""
    begin = wide.to_points(starts)
    n = wide.to_points(ends) - begin
    low, high = _ordered(first, second, n)
    return Cuts(n, wide.to_bytes(begin + low), wide.to_bytes(begin + high), _marked(data, starts, ends))


def _ordered(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = first % (n + 1), second % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Documents that hold a whole mark themselves."""
    if len(data) < 3:
        return np.zeros(len(starts), bool)
    letter = np.isin(data[1:-1], np.frombuffer(MARK_LETTERS.encode(), np.uint8))
    at = np.flatnonzero((data[:-2] == ord("<")) & letter & (data[2:] == ord(">")))
    return np.searchsorted(at, np.maximum(ends - 2, starts)) > np.searchsorted(at, starts)


def _assembled(data: bytes, starts, low, high, ends, form) -> pa.Array:
    """The texts of one piece: prefix, middle and suffix in the order of each form."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    parts, lengths = [], np.where(form == 0, ends - starts, ends - starts + len(p) + len(s) + len(m))
    for a, b, c, d, f in zip(starts.tolist(), low.tolist(), high.tolist(), ends.tolist(), form.tolist(), strict=True):
        if f == 0:
            parts.append(data[a:d])
        elif f == 1:
            parts += (p, data[a:b], s, data[c:d], m, data[b:c])
        else:
            parts += (s, data[c:d], p, data[a:b], m, data[b:c])
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))]
    return pa.LargeStringArray.from_buffers(len(lengths), buffers[1], buffers[2]).cast(pa.string())


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    rate: int = 50,
    suffix_first: int = 80,
    unit: str = "token",
) -> DataFrame:
    """``rate`` percent of the documents with the middle last, of those ``suffix_first`` percent with the suffix in front.

    The cuts stand after a number of ``unit``s ("token" or "char") that the id and the seed draw.  Gives the id, ``n``
    (units), ``form`` (plain, psm or spm), ``output``, and ``prefix_chars``, ``middle_chars``, ``prefix_bytes`` and
    ``middle_bytes`` (null where plain).  Empty texts, and texts that hold a mark, are plain, so ``restore`` is exact.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"no such unit: {unit}")
    h = draws(F.col(id), seed, 4)
    form = F.when(h[2] % 100 >= rate, 0).when(h[3] % 100 < suffix_first, 2).otherwise(1)
    rows = docs.select(
        F.col(id).alias("id"), F.col(text).alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form")
    )

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        h1, h2, form = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "form"))
        for i, j in pieces(offsets, PIECE_BYTES):
            part = data[offsets[i] : offsets[j]]
            starts, ends = offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
            wide = Wide.of(part)
            if unit == "token":
                cuts = token_cuts(part, starts, ends, h1[i:j], h2[i:j])
            else:
                cuts = point_cuts(part, starts, ends, h1[i:j], h2[i:j], wide)
            form_here = np.where((ends == starts) | cuts.marked, 0, form[i:j])
            plain = form_here == 0
            a, b, c = (wide.to_points(x) for x in (starts, cuts.low, cuts.high))
            yield {
                "id": batch.column("id").slice(i, j - i),
                "n": pa.array(cuts.n, pa.int64()),
                "form": pa.array(np.array(FORMS)[form_here], pa.string()),
                "output": _assembled(part.tobytes(), starts, cuts.low, cuts.high, ends, form_here),
                "prefix_chars": pa.array(b - a, pa.int64(), mask=plain),
                "middle_chars": pa.array(c - b, pa.int64(), mask=plain),
                "prefix_bytes": pa.array(cuts.low - starts, pa.int64(), mask=plain),
                "middle_bytes": pa.array(cuts.high - cuts.low, pa.int64(), mask=plain),
            }

    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, n bigint, form string, output string, prefix_chars bigint,"
        " middle_chars bigint, prefix_bytes bigint, middle_bytes bigint"
    )
    return map_arrow(rows, work, schema).withColumnRenamed("id", id)


def restore(made: DataFrame, output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """The exact text of each row as ``text``, from its output and its form alone.

    A text that holds a mark is plain, and no mark begins as another ends, so the three marks of an output are the only ones.
    """
    parts = F.split(F.col(output), f"<[{MARK_LETTERS}]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return made.withColumn(text, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output)))


def report(docs: DataFrame) -> DataFrame:
    """Digests of what each document becomes, and of what is rebuilt from that."""
    made = restore(fill_in_middle(docs))
    digest = {f"{n}_sha256": F.sha2(F.col(c).cast("binary"), 256) for n, c in (("output", "output"), ("restored", "text"))}
    return made.withColumns(digest).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
