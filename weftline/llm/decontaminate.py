"""Benchmark decontamination with a generalised suffix automaton of the items.

Items are normalised to words (ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased) and put into
one automaton over words, each item from the root.  A document streams through it: the state after a word stands for
the longest item passage that ends there, so a window of ``window`` words ends at a word exactly if the longest match
is that long, and a shorter item occurs if the match reaches it.  A state knows the items of its windows.

Before the automaton, numpy drops what cannot match: a word counts only in a run of word pairs that items have, and a
run only if it is long enough for the shortest item.  So Python steps run over near-matches alone.

The automaton is broadcast.  Its size is bounded: items are dealt into shards of at most ``SHARD_WORDS`` words by their
id, the words of each are counted first, and the documents pass over one shard's automaton after the other with their
hits carried along.  Benchmarks of usual sizes are one shard.

Cases: null text and text without words: 0 words, no hit; an item without words never occurs; null item ids are
counted like others and left out of the list; repeated rows are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM, U64, _BASE, map_arrow, mix, pieces, texts, words

SHARD_WORDS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Generalised suffix automaton over hashed words."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self.marks = self._marks(items)
        self.shortest = min((min(len(item), window) for _, item in items if item), default=0)
        self.pairs = self._pairs(items)
        self.vocabulary = np.unique(np.array([w for _, item in items for w in item], U64))

    def _copy(self, p: int, q: int, word: int) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, word)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match that ends with ``word``, after one of ``length`` words that ended in ``state``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def window_state(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _marks(self, items) -> list[dict[int, set]]:
        """For each state, window sizes and the items with such a window there."""
        marks: dict[int, dict[int, set]] = {}
        for item_id, item in items:
            size = min(len(item), self.window)
            state = length = 0
            for word in item:
                state, length = self.step(state, length, word)
                if length >= size:
                    marks.setdefault(self.window_state(state, size), {}).setdefault(size, set()).add(item_id)
        return [marks.get(s, {}) for s in range(len(self.length))]

    @staticmethod
    def _pairs(items) -> np.ndarray:
        found = [pair_codes(np.array(item, U64)) for _, item in items if len(item) > 1]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, U64)

    def found(self, state: int, length: int) -> Iterator[tuple[int, set]]:
        """(size, items) of all windows that end where a match of ``length`` words ends."""
        while state > 0:
            for size, items in self.marks[state].items():
                if size <= length:
                    yield size, items
            state = self.link[state]
            length = self.length[state]


def pair_codes(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(code[:-1] * U64(_BASE) + code[1:])


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _runs(code: np.ndarray, first: np.ndarray, machine: Automaton) -> Iterator[tuple[int, int]]:
    """Ranges of words in one document that may hold a window."""
    n = len(code)
    if machine.shortest <= 1:
        linked = _member(code, machine.vocabulary)
        least = 1
    else:
        linked = np.zeros(n, bool)  # position k: the pair of words k and k + 1
        linked[: n - 1] = _member(pair_codes(code), machine.pairs)
        linked[(first[1:] - 1)[np.diff(first) > 0]] = False
        least = machine.shortest - 1
    step = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
    opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = closes - opens >= least
    extra = 0 if machine.shortest <= 1 else 1
    if machine.shortest <= 1:  # such runs may cross documents: cut them there
        for a, b in zip(opens[long], closes[long], strict=True):
            cuts = first[np.searchsorted(first, a, "right") : np.searchsorted(first, b, "left")]
            edges = [a, *np.unique(cuts).tolist(), b]
            yield from zip(edges[:-1], edges[1:], strict=True)
        return
    yield from zip((opens[long]).tolist(), (closes[long] + extra).tolist(), strict=True)


def hits(code: np.ndarray, first: np.ndarray, machine: Automaton) -> tuple[np.ndarray, dict[int, set]]:
    """Which words are hit, and the items of each document that has any."""
    hit = np.zeros(len(code), bool)
    items: dict[int, set] = {}
    for a, b in _runs(code, first, machine):
        doc = int(np.searchsorted(first, a, "right")) - 1
        state = length = 0
        for k, word in enumerate(code[a:b].tolist(), a):
            state, length = machine.step(state, length, word)
            if length >= machine.shortest:
                for size, names in machine.found(state, length):
                    hit[k + 1 - size : k + 1] = True
                    items.setdefault(doc, set()).update(names)
    return hit, items


def item_words(text: str | None) -> list[int]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM).code.tolist()


def machines(benchmark: DataFrame, window: int) -> list[Automaton]:
    """Automata of the items, each of at most ``SHARD_WORDS`` words (or one longer item)."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    total = benchmark.agg(F.sum(count).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    out = []
    for k in range(shards):
        rows = benchmark.filter(shard == k).select("item_id", "text").collect()
        items = [(None if r["item_id"] is None else str(r["item_id"]), item_words(r["text"])) for r in rows]
        out.append(Automaton([(i, w) for i, w in items if w], window))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``row`` (a document's columns as a struct), ``n_words``, ``n_hit``, ``hits`` (packed bits, one for each word;
    null: none) and ``items`` (ids as sorted texts, null for a null id)."""
    spark = docs.sparkSession
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = out.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "n_hit": F.lit(0).cast("long"),
            "hits": F.lit(None).cast("binary"),
            "items": F.array().cast("array<string>"),
        }
    )
    for machine in machines(benchmark, window):
        shared = spark.sparkContext.broadcast(machine)

        def work(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            automaton = shared.value
            rows = batch.column("row")
            data, offsets = texts(pc.struct_field(rows, "text"))
            before, known = batch.column("hits"), batch.column("items")
            for i, j in pieces(offsets):
                cuts = offsets[i : j + 1] - offsets[i]
                found = words(data[offsets[i] : offsets[j]], cuts, ALNUM)
                hit, items = hits(found.code, found.first, automaton)
                bits, lists, counts = [], [], []
                for d in range(j - i):
                    own = hit[found.first[d] : found.first[d + 1]]
                    old, had = before[i + d].as_py(), known[i + d].as_py()
                    if old is not None:
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
                    counts.append(int(own.sum()))
                    bits.append(np.packbits(own).tobytes() if counts[-1] else None)
                    more = items.get(d)
                    lists.append(sorted({*had, *more}, key=lambda x: (x is None, x or "")) if more else had)
                yield {
                    "row": rows.slice(i, j - i),
                    "n_words": pa.array(np.diff(found.first).astype(np.int64)),
                    "n_hit": pa.array(counts, pa.int64()),
                    "hits": pa.array(bits, pa.binary()),
                    "items": pa.array(lists, pa.list_(pa.string())),
                }

        out = map_arrow(out, work, out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each document."""
    marked = mark(docs.select("doc_id", "text"), benchmark, window=window)
    return marked.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, coverage: float = 0.2) -> DataFrame:
    """Documents without their hit words; those of which more than ``coverage`` of the words are hit go whole.

    Each hit word goes with what follows it up to the next word.  With ``coverage`` 0 every hit document goes.
    """
    marked = mark(docs, benchmark, window=window)
    left = marked.filter(F.col("n_hit") <= F.lit(coverage) * F.col("n_words"))
    if coverage <= 0:
        return left.select("row.*")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = batch.column("row")
        column = pc.struct_field(rows, "text").to_pylist()
        for k, bits in enumerate(batch.column("hits").to_pylist()):
            if bits is not None:
                raw = column[k].encode()
                found = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(found.code)).astype(bool)
                following = np.append(found.start[1:], len(raw))
                keep = np.ones(len(raw), bool)
                for a, b in zip(found.start[hit], following[hit], strict=True):
                    keep[a:b] = False
                column[k] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
        yield {"row": rows, "cut": pa.array(column, pa.string())}

    kind = left.schema["row"].dataType.simpleString()
    new = map_arrow(left.select("row", "hits"), cut, f"row {kind}, cut string")
    return new.select(*[F.col("cut").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
