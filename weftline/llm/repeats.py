"""Which windows of ``length`` tokens also start in a document with a smaller id, exactly and without shipping all windows.

Every window has an anchor: of its grams of ``gram`` tokens the one with the smallest hash (the leftmost of equals), a
choice that depends on the window's tokens only.  Neighbouring windows mostly share their anchor, so there are about
2 / (length - gram + 2) anchors for a token.  The windows of one anchor occurrence make a segment of at most
``2 * length - gram`` tokens.

1. Documents are packed into rows of about half a megabyte (compressed, with all their ids) and written.
2. Each pack sends its distinct anchors, dealt by hash into parts: key, hash of the segment (or a sign that the pack
   has several), smallest id.  A pack combines first, so an anchor that a third of all documents share is one entry
   for each pack.  A part answers for each entry: nowhere else; everywhere the same segment, and whether a smaller id
   has it; or differing segments.  In the second case all windows of the segment are decided at once.
3. Differing segments (edges of repeated passages) are sent with their tokens to the part of their anchor, where all
   windows that could be equal meet, and are compared there by the operator's own method.  Answers are one bit for
   each window.
4. Anchors with differing segments in more than ``HOT`` packs don't meet in one part: their windows are counted by a
   plain aggregate (128-bit hash, smallest id) that combines before its shuffle.

Parts and packs keep their size as the data grow; only their number rises.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import U64, _BASE, _INVERSE, _powers, map_arrow, mix, pieces, texts, within, written

PACK_BYTES = 1 << 19
PART_ANCHORS = 400_000
HASH_TOKENS = 1 << 18
HOT = 4000
NO_ID = np.iinfo(np.int64).max
ALONE, FIRST, LATER, DIFFER, WIDE = range(5)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<Q", a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def spread(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    sizes = struct.unpack_from(f"<{n}Q", raw, 4)
    at, out = 4 + 8 * n, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` and ``body`` (text bytes, where each document begins, ids; a null id is the largest number)."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        rng = np.random.default_rng()
        for i, j in pieces(offsets, PACK_BYTES):
            body = squeeze(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j])
            yield {
                "pack": pa.array([int(rng.integers(1 << 62))], pa.int64()),
                "body": pa.array([body], pa.binary()),
                "bytes": pa.array([int(offsets[j] - offsets[i])], pa.int64()),
            }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_arrow(rows, work, "pack long, body binary, bytes long"), "packs")


@dataclass
class Tokens:
    """Tokens of some documents: values, and where each document's begin (one more entry than documents)."""

    code: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Plan:
    """What the two operators differ in.

    ``tokens(data, cuts)`` cuts bytes into tokens; ``compare(docs, lengths, codes, length)`` gets the segments of a
    part and gives a bit mask of windows that a smaller id has; ``finish(data, cuts, dead)`` makes the result columns
    of each document from the token starts of dead windows.
    """

    length: int
    gram: int
    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    kind: type
    compare: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
    finish: Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict[str, pa.Array]]
    schema: str


_UP, _DOWN = _powers(_BASE, PACK_BYTES + 1), _powers(_INVERSE, PACK_BYTES + 1)


def _value(code: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        if code.dtype == np.uint8:
            return _value(np.arange(256, dtype=U64), salt)[code]
        return mix(code * U64(0xD1342543DE82EF95) + U64(2 * salt + 1))


class Hasher:
    """Hashes of any token range of one sequence, from prefix sums."""

    def __init__(self, code: np.ndarray, salt: int = 0):
        n = len(code) + 1
        up, self.down = (_UP[:n], _DOWN[:n]) if n <= len(_UP) else (_powers(_BASE, n), _powers(_INVERSE, n))
        self.run = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_value(code, salt) * up[:-1], out=self.run[1:])

    def ranges(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[start + size] - self.run[start]) * self.down[start] + np.asarray(size).astype(U64))


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Anchors:
    """Anchor occurrences of a pack in order: key, place, first window, number of windows, hash of the segment, document."""

    key: np.ndarray
    at: np.ndarray
    start: np.ndarray
    count: np.ndarray
    segment: np.ndarray
    doc: np.ndarray


def anchors(t: Tokens, length: int, gram: int) -> Anchors:
    total, w = len(t.code), length - gram + 1
    ok = within(t.first, length, total)
    if not ok.any():
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(U64), none, none, none, none.astype(U64), none)
    hasher = Hasher(t.code)
    grams = hasher.ranges(np.arange(total - gram + 1), gram)
    marked = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    place = (_slide(marked, w) & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(ok), bool)
    new[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    # a run ends before the next start or the next window that crosses documents
    edge = np.flatnonzero(np.append(new | ~ok, True))
    count = edge[np.searchsorted(edge, start, "right")] - start
    at = place[start]
    with np.errstate(over="ignore"):
        segment = mix(hasher.ranges(start, count + length - 1) + (at - start).astype(U64) * U64(_BASE))
    # smallest hashes are not spread evenly: mixed again, keys are
    return Anchors(mix(grams[at] ^ U64(_BASE)), at, start, count, segment, np.searchsorted(t.first, start, "right") - 1)


@dataclass
class Entries:
    """Distinct keys of a pack in the order of (part, key), with the entry of each anchor."""

    key: np.ndarray
    part: np.ndarray
    low: np.ndarray
    segment: np.ndarray
    of: np.ndarray
    edges: np.ndarray


def entries(a: Anchors, ids: np.ndarray, parts: int) -> Entries:
    key, of = np.unique(a.key, return_inverse=True)
    part = ((key >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)  # ascending with the key
    low = np.full(len(key), NO_ID)
    np.minimum.at(low, of, ids[a.doc])
    least = np.full(len(key), U64(0xFFFFFFFFFFFFFFFF))
    most = np.zeros(len(key), U64)
    short = (a.segment >> U64(24)) + U64(1)  # 40 bits, never 0
    np.minimum.at(least, of, short)
    np.maximum.at(most, of, short)
    return Entries(key, part, low, np.where(least == most, most, U64(0)), of, np.searchsorted(part, np.arange(parts + 1)))


_LOW40 = U64((1 << 40) - 1)


def _split40(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & U64(0xFFFFFFFF)).astype(np.uint32), (x >> U64(32)).astype(np.uint16)


def _join40(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | (high.astype(U64) << U64(32))


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(spread(body, np.uint8, np.int64, np.int64))


def _asked(plan: Plan, parts: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for pack, body in zip(batch.column("pack").to_pylist(), batch.column("body"), strict=True):
            data, cuts, ids = _opened(body.as_buffer().to_pybytes())
            e = entries(anchors(plan.tokens(data, cuts), plan.length, plan.gram), ids, parts)
            some = np.flatnonzero(np.diff(e.edges))
            bodies = []
            for p in some:
                s = slice(e.edges[p], e.edges[p + 1])
                bodies.append(squeeze(*_split40(e.key[s] & _LOW40), *_split40(e.segment[s]), e.low[s]))
            if len(some):
                yield {
                    "part": pa.array(some, pa.int32()),
                    "pack": pa.array(np.full(len(some), pack)),
                    "body": pa.array(bodies, pa.binary()),
                }

    return work


def _groups(order_key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1]))) if len(order_key) else np.zeros(0, int)


def answer(messages: pa.Table) -> pa.Table:
    """For each entry of each message of a part: where else its anchor is."""
    packs = messages.column("pack").to_pylist()
    parts = [spread(b, np.uint32, np.uint16, np.uint32, np.uint16, np.int64) for b in messages.column("body").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    joined = [np.concatenate([p[k] for p in parts]) for k in range(5)]
    key, segment, low = _join40(joined[0], joined[1]), _join40(joined[2], joined[3]), joined[4]
    order = np.argsort(key, kind="stable")
    start = _groups(key[order])
    number = np.diff(np.append(start, len(key)))
    first = np.minimum.reduceat(low[order], start) if len(start) else low
    least, most = (f.reduceat(segment[order], start) if len(start) else segment for f in (np.minimum, np.maximum))
    same = (least == most) & (least > 0)
    code = np.where(same, np.where(number > 1, FIRST, ALONE), np.where(number > HOT, WIDE, DIFFER))
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(start)), number)
    out = code[of].astype(np.uint8)
    out[(out == FIRST) & (low > first[of])] = LATER
    bodies = [squeeze(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pa.table(
        {
            "pack": pa.array(packs, pa.int64()),
            "kind": pa.array([1] * len(packs), pa.int32()),
            "part": messages.column("part").combine_chunks(),
            "body": pa.array(bodies, pa.binary()),
        }
    )


ANSWER = "pack long, kind int, part int, body binary"


def _codes(e: Entries, answers: list[dict]) -> np.ndarray:
    out = np.full(len(e.key), ALONE, np.uint8)
    for a in answers:
        if a["kind"] == 1:
            out[e.edges[a["part"]] : e.edges[a["part"] + 1]] = spread(a["body"], np.uint8)[0]
    return out


def _windows(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All window starts of some segments."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total) if total else np.zeros(0, np.int64)


def _differing(plan: Plan, parts: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for pack, body, answers in zip(batch.column("pack").to_pylist(), batch.column("body"), batch.column("answers"), strict=True):
            data, cuts, ids = _opened(body.as_buffer().to_pybytes())
            t = plan.tokens(data, cuts)
            a = anchors(t, plan.length, plan.gram)
            e = entries(a, ids, parts)
            code = _codes(e, answers.as_py() or [])[e.of]
            rows = []
            part = e.part[e.of]
            for chosen, at in _by_part(code, part):
                size = a.count[chosen] + plan.length - 1
                place = (a.at[chosen] - a.start[chosen]).astype(np.uint8)
                rows.append((at, squeeze(ids[a.doc[chosen]], size, place, t.code[_windows(a.start[chosen], size)])))
            wide = np.flatnonzero(code == WIDE)
            h1 = h2 = low = np.zeros(0, np.int64)
            if len(wide):
                windows = _windows(a.start[wide], a.count[wide])
                doc = np.repeat(ids[a.doc[wide]], a.count[wide])
                h1, h2 = (Hasher(t.code, s).ranges(windows, plan.length).astype(np.int64) for s in (1, 2))
                order = np.lexsort((doc, h2, h1))
                h1, h2, low = h1[order], h2[order], doc[order]
                new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
                h1, h2, low = h1[new], h2[new], low[new]
            n, m = len(rows), len(h1)
            if n + m:
                yield {
                    "part": pa.array([r[0] for r in rows] + [-1] * m, pa.int32()),
                    "pack": pa.array(np.full(n + m, pack)),
                    "body": pa.array([r[1] for r in rows] + [None] * m, pa.binary()),
                    "h1": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(h1)]),
                    "h2": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(h2)]),
                    "low": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(low)]),
                }

    return work


def _by_part(code: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Anchors with differing segments, part by part, each in the pack's order."""
    chosen = np.flatnonzero(code == DIFFER)
    order = np.argsort(part[chosen], kind="stable")
    chosen = chosen[order]
    for s in np.split(chosen, _groups(part[chosen])[1:]):
        if len(s):
            yield s, int(part[s[0]])


def _compared(plan: Plan):
    def work(messages: pa.Table) -> pa.Table:
        packs = messages.column("pack").to_pylist()
        got = [spread(b, np.int64, np.int64, np.uint8, plan.kind) for b in messages.column("body").to_pylist()]
        mask = distinct_compare(plan, *(np.concatenate([g[k] for g in got]) for k in range(4)))
        bodies = [squeeze(m) for m in np.split(mask, np.cumsum([len(g[0]) for g in got])[:-1])]
        return pa.table(
            {
                "pack": pa.array(packs, pa.int64()),
                "kind": pa.array([2] * len(packs), pa.int32()),
                "part": messages.column("part").combine_chunks(),
                "body": pa.array(bodies, pa.binary()),
            }
        )

    return work


def _range_hashes(codes: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Hash of one range inside each segment (``at``: bounds of the segments), block by block."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(at, at[i] + HASH_TOKENS, "right")) - 1)
        out[i:j] = Hasher(codes[at[i] : at[j]], salt).ranges(start[i:j] - at[i], size[i:j])
        i = j
    return out


def _shared(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True for known values that are there twice or more."""
    _, of, number = np.unique(value[known], return_inverse=True, return_counts=True)
    out = np.zeros(len(value), bool)
    out[known] = number[of] > 1
    return out


def distinct_compare(plan: Plan, docs: np.ndarray, sizes: np.ndarray, place: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bit masks of dead windows.

    Of equal segments only the one with the smallest id is compared.  A window has half of what it holds besides the
    anchor on one side of it at least, so a segment is compared only if it shares the anchor with that much to the
    left, or to the right, with another one.
    """
    at = np.concatenate(([0], np.cumsum(sizes)))
    h1, h2 = (_range_hashes(codes, at, at[:-1], sizes, s) for s in (1, 2))
    order = np.lexsort((docs, h2, h1))
    new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
    rep = order[new]
    of = np.empty(len(docs), np.int64)
    of[order] = np.cumsum(new) - 1
    codes, size, place = codes[_windows(at[:-1][rep], sizes[rep])], sizes[rep], place[rep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    side = -(-(plan.length - plan.gram) // 2)
    candidate = np.zeros(len(rep), bool)
    for known, start in ((place >= side, place - side), (place + plan.gram + side <= size, place)):
        n = np.where(known, plan.gram + side, 0)
        candidate |= _shared(_range_hashes(codes, at, at[:-1] + np.where(known, start, 0), n, 3), known)
    some = np.flatnonzero(candidate)
    mask = np.zeros(len(rep), U64)
    if len(some):
        mask[some] = plan.compare(docs[rep][some], size[some], codes[_windows(at[:-1][some], size[some])], plan.length)
    whole = (U64(1) << (sizes - plan.length + 1).astype(U64)) - U64(1)
    return np.where(docs > docs[rep][of], whole, mask[of]).astype(U64)


def _finished(plan: Plan, parts: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        columns = (batch.column(c) for c in ("body", "answers", "wide"))
        for body, answers, wide in zip(*columns, strict=True):
            data, cuts, ids = _opened(body.as_buffer().to_pybytes())
            t = plan.tokens(data, cuts)
            a = anchors(t, plan.length, plan.gram)
            e = entries(a, ids, parts)
            known = answers.as_py() or []
            code = _codes(e, known)[e.of]
            dead = (code == LATER) | ((code <= FIRST) & (ids[a.doc] > e.low[e.of]))
            starts = [_windows(a.start[dead], a.count[dead])]
            part = e.part[e.of]
            masks = {x["part"]: x["body"] for x in known if x["kind"] == 2}
            for chosen, at in _by_part(code, part):
                mask = spread(masks[at], U64)[0]
                n = a.count[chosen]
                bit = _windows(np.zeros(len(n), np.int64), n).astype(U64)
                on = (np.repeat(mask, n) >> bit) & U64(1) == 1
                starts.append(_windows(a.start[chosen], n)[on])
            chosen = np.flatnonzero(code == WIDE)
            if len(chosen):
                windows = _windows(a.start[chosen], a.count[chosen])
                doc = np.repeat(ids[a.doc[chosen]], a.count[chosen])
                h1, h2 = (Hasher(t.code, s).ranges(windows, plan.length).astype(np.int64) for s in (1, 2))
                later = {(x["h1"], x["h2"]) for x in wide.as_py() or []}
                low: dict[tuple, int] = {}
                pairs = list(zip(h1.tolist(), h2.tolist(), strict=True))
                for pair, d in zip(pairs, doc.tolist(), strict=True):
                    low[pair] = min(d, low.get(pair, NO_ID))
                on = [p in later or d > low[p] for p, d in zip(pairs, doc.tolist(), strict=True)]
                starts.append(windows[np.array(on, bool)])
            out = plan.finish(data, cuts, np.concatenate(starts), plan.length)
            yield {"doc_id": pa.array(ids, mask=ids == NO_ID)} | out

    return work


def find_repeats(docs: DataFrame, plan: Plan) -> DataFrame:
    """``plan.schema`` for each document."""
    packs = pack_documents(docs)
    total = packs.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    density = 2 / (plan.length - plan.gram + 2) / (1 if plan.kind is np.uint8 else 5)
    parts = max(1, int(total * density / PART_ANCHORS) + 1)
    asked = map_arrow(packs.select("pack", "body"), _asked(plan, parts), "part int, pack long, body binary")
    answers = written(asked.groupBy("part").applyInArrow(answer, ANSWER), "repeat-answers")

    def with_answers(known: DataFrame) -> DataFrame:
        by_pack = known.groupBy("pack").agg(F.collect_list(F.struct("kind", "part", "body")).alias("answers"))
        by_pack = by_pack.withColumnRenamed("pack", "p")
        return packs.select("pack", "body").join(by_pack, F.col("pack") == F.col("p"), "left").drop("p")

    schema = "part int, pack long, body binary, h1 long, h2 long, low long"
    differing = written(map_arrow(with_answers(answers), _differing(plan, parts), schema), "repeat-differing")
    narrow = differing.filter("part >= 0").select("part", "pack", "body")
    masks = written(narrow.groupBy("part").applyInArrow(_compared(plan), ANSWER), "repeat-masks")
    wide = differing.filter("part < 0").select("pack", "h1", "h2", "low")
    least = wide.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most")
    least = written(least.withColumnsRenamed({"h1": "k1", "h2": "k2"}), "repeat-wide")
    later = wide.join(least, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).filter("least < low")
    later = later.groupBy("pack").agg(F.collect_list(F.struct("h1", "h2")).alias("wide")).withColumnRenamed("pack", "q")
    known = with_answers(answers.union(masks))
    joined = known.join(written(later, "repeat-later"), F.col("pack") == F.col("q"), "left").select("body", "answers", "wide")
    return map_arrow(joined, _finished(plan, parts), plan.schema)
