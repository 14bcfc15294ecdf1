"""Substring deduplication over words with suffix automata of reference shards.

A window of 50 words goes where its word sequence also starts in a document with a smaller id.  An automaton of the
whole corpus has no size bound and can't be broadcast, so reference shards are made of what can match at all (see
``repeats``): the differing segments around anchors that several documents share, dealt by anchor, so that all equal
windows meet in one shard.  In a shard the segments are streamed in the order of their ids through a generalised
suffix automaton of the segments of smaller ids; the matching statistics (longest match that ends at each word) say
which windows are repeats, and then the segment joins the automaton.

Cases: null or empty text has no words; documents of fewer words than a window lose nothing; equal ids (and null ids,
which rank last) take nothing from each other; repeated rows are judged one by one; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import PLAIN, U64, cover, words
from weftline.llm.repeats import Plan, Tokens, find_repeats

LENGTH, GRAM = 50, 25


class Automaton:
    """Generalised suffix automaton that is streamed through and extended in turn."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, q: int, token: int) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.link[q] = clone
        moves = self.next
        while p >= 0 and moves[p].get(token) == q:
            moves[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int]) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for token in tokens:
            q = moves[last].get(token)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copy(last, q, token)
                continue
            new = len(length)
            length.append(length[last] + 1)
            moves.append({})
            link.append(0)
            p = last
            while p >= 0 and token not in moves[p]:
                moves[p][token] = new
                p = link[p]
            if p >= 0:
                q = moves[p][token]
                link[new] = q if length[q] == length[p] + 1 else self._copy(p, q, token)
            last = new

    def matches(self, tokens: list[int]) -> list[int]:
        """Length of the longest match that ends at each token."""
        moves, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for token in tokens:
            to = moves[state].get(token)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = moves[state].get(token)
            state, size = (0, 0) if to is None else (to, size + 1)
            out.append(size)
        return out


def stream(docs: np.ndarray, sizes: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """Bit mask of the windows of each segment that a segment of a smaller id has."""
    at = np.concatenate(([0], np.cumsum(sizes))).tolist()
    out = np.zeros(len(docs), U64)
    machine, waiting, current = Automaton(), [], None
    order = np.argsort(docs, kind="stable").tolist()
    ids, values = docs.tolist(), codes.tolist()
    for s in order:
        if ids[s] != current:
            for tokens in waiting:
                machine.add(tokens)
            waiting, current = [], ids[s]
        tokens = values[at[s] : at[s + 1]]
        mask = 0
        for k, size in enumerate(machine.matches(tokens)[length - 1 :]):
            if size >= length:
                mask |= 1 << k
        out[s] = mask
        waiting.append(tokens)
    return out


def _tokens(data: np.ndarray, cuts: np.ndarray) -> Tokens:
    found = words(data, cuts, PLAIN)
    return Tokens(found.code, found.first)


def _finish(data: np.ndarray, cuts: np.ndarray, dead: np.ndarray, length: int) -> dict[str, pa.Array]:
    found = words(data, cuts, PLAIN)
    gone = cover(dead, length, len(found.code))
    removed, kept = [], []
    raw = data.tobytes()
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        own = ~gone[a:b]
        removed.append(int(b - a - own.sum()))
        pieces = [raw[s:e] for s, e in zip(found.start[a:b][own].tolist(), found.end[a:b][own].tolist(), strict=True)]
        kept.append(b" ".join(pieces))
    return {
        "n_words": pa.array(np.diff(found.first).astype(np.int64)),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    }


PLAN = Plan(LENGTH, GRAM, _tokens, U64, stream, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words for each document."""
    return find_repeats(docs, PLAN)
