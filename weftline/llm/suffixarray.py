"""Byte-substring deduplication with suffix arrays of shards.

A byte goes where a 50-byte string that covers it also starts in a document with a smaller id.  Candidate segments meet
by anchor (see ``repeats``); the segments of a part are cut into shards of about a quarter of a megabyte.  Each shard gets a suffix
array by Larsson-Sadakane refinement (ranks by seven bytes, then doubled; only groups that are not yet sorted are
sorted again) and common prefixes by Kasai's scan.  Neighbours in the array that share 50 bytes are one class, whose
smallest id counts.  The classes of the shards are merged in sorted order by binary search.

Cases: null or empty text has no bytes; texts below 50 bytes lose nothing; equal ids (and null ids, which rank last)
take nothing from each other; removal may cut a character in two, as bytes are asked for; repeated rows are judged
one by one; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import U64, cover
from weftline.llm.repeats import Plan, Tokens, _windows, find_repeats

LENGTH, GRAM = 50, 20
SHARD_BYTES = 1 << 18
STEP = 7


def suffix_array(data: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(array, rank) of all suffixes, each up to its ``end``, sorted by at least their first ``depth`` bytes."""
    n = len(data)
    padded = np.concatenate((data.astype(np.int64) + 1, np.zeros(STEP, np.int64)))
    key = np.zeros(n, np.int64)
    at = np.arange(n)
    for k in range(STEP):
        key = key * 257 + np.where(at + k < end, padded[k : k + n], 0)
    array = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[array][1:] != key[array][:-1]))
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(new, at, 0))
    size = STEP
    while size < depth:
        starts = np.append(np.flatnonzero(new), n)
        open_ = np.repeat(np.diff(starts) > 1, np.diff(starts))
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        group = array[slots]
        further = group + size
        second = np.where(further < end[group], rank[np.minimum(further, n - 1)], -1)
        order = np.lexsort((second, rank[group]))
        array[slots] = group[order]
        own, second = rank[group][order], second[order]
        split = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        new[slots] = split
        rank[array] = np.maximum.accumulate(np.where(new, at, 0))
        size *= 2
    return array, rank


def common_prefixes(data: np.ndarray, at: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Kasai's scan: bytes that each suffix shares with the one before it in the array, up to ``most``.

    A suffix shares at least one byte less than the suffix one place to its left in the text.  All segments (bounded
    by ``at``) are scanned at once, place by place.
    """
    n = len(array)
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    before = np.where(place > 0, array[place - 1], -1)
    stop = np.repeat(at[1:], np.diff(at))
    out = np.zeros(n, np.int32)
    shared = np.zeros(len(at) - 1, np.int64)
    for k in range(int(np.diff(at).max(initial=0))):
        own = np.flatnonzero(at[:-1] + k < at[1:])
        i = at[own] + k
        j = before[i]
        limit = np.where(j < 0, 0, np.minimum(most, np.minimum(stop[i] - i, stop[j] - j)))
        size = np.minimum(np.maximum(shared[own] - 1, 0), limit)
        going = np.flatnonzero(size < limit)
        while len(going):
            going = going[data[i[going] + size[going]] == data[j[going] + size[going]]]
            size[going] += 1
            going = going[size[going] < limit[going]]
        out[place[i]] = size
        shared[own] = size
    return out


def classes(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ``length``-byte strings of a shard, the smallest id of each, and the class of each window."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    end = np.repeat(at[1:], sizes)
    # to the full depth: Kasai's scan needs true order, equal suffixes by position
    array, _ = suffix_array(data, end, int(sizes.max()))
    shared = common_prefixes(data, at, array, length)
    full = array + length <= end[array]
    window, joined = array[full], shared[full] >= length
    number = np.cumsum(~joined) - 1
    owner = np.repeat(docs, sizes)[window]
    starts = np.flatnonzero(~joined)
    low = np.minimum.reduceat(owner, starts)
    heads = window[starts]
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[heads]).view(f"S{length}").ravel()
    of = np.full(len(data), -1)
    of[window] = number
    return text, low, of[_windows(at[:-1], sizes - length + 1)]


def merge(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Bit mask of the windows of each segment that a smaller id has, over all shards of a part."""
    if not len(docs):
        return np.zeros(0, U64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    shards, i = [], 0
    while i < len(docs):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SHARD_BYTES, "right")) - 1)
        shards.append((i, j, *classes(docs[i:j], sizes[i:j], data[at[i] : at[j]], length)))
        i = j
    text, low = shards[0][2], shards[0][3].copy()
    for _, _, own, least, _ in shards[1:]:
        place = np.minimum(np.searchsorted(text, own), len(text) - 1)
        known = text[place] == own
        np.minimum.at(low, place[known], least[known])
        spots = np.searchsorted(text, own[~known])
        text, low = np.insert(text, spots, own[~known]), np.insert(low, spots, least[~known])
    out = np.zeros(len(docs), U64)
    for i, j, own, _, of in shards:
        least = low[np.searchsorted(text, own)]
        count = sizes[i:j] - length + 1
        dead = least[of] < np.repeat(docs[i:j], count)
        bit = U64(1) << _windows(np.zeros(j - i, np.int64), count).astype(U64)
        out[i:j] = np.add.reduceat(np.where(dead, bit, U64(0)), np.concatenate(([0], np.cumsum(count)[:-1])))
    return out


def _finish(data: np.ndarray, cuts: np.ndarray, dead: np.ndarray, length: int) -> dict[str, pa.Array]:
    gone = cover(dead, length, len(data))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    edge = cuts[:-1][cuts[:-1] < len(data)]
    opens[edge] = gone[edge]
    run, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, opens))
    digests = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = data[a:b]
        digests.append(hashlib.sha256(own[~gone[a:b]].tobytes() if run[b] > run[a] else own.tobytes()).hexdigest())
    return {
        "n_bytes": pa.array(np.diff(cuts)),
        "n_removed": pa.array((run[cuts[1:]] - run[cuts[:-1]]).astype(np.int64)),
        "n_spans": pa.array((spans[cuts[1:]] - spans[cuts[:-1]]).astype(np.int64)),
        "kept_sha256": pa.array(digests, pa.string()),
    }


PLAN = Plan(
    LENGTH, GRAM, Tokens, np.uint8, merge, _finish,
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes for each document."""
    return find_repeats(docs, PLAN)
