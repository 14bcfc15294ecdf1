"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

A document is a sequence of its lines.  The score of a labelling is the sum of a weight for each line's shape features
(one-hot bins, and whether the line was there before) under its label and a weight for each pair of neighbouring
labels.  Viterbi decoding gives each line's label, and a document is kept if enough of its words stand in content
lines and it doesn't fail the base rules.

Only documents are labelled, so the labels of lines are hidden while learning, and what is known of them is a bound on
the share of words in content lines: at least ``GOOD`` in a good document, at most ``BAD`` in a bad one.  This is
expectation and maximisation under posterior constraints: the expected labels are those of the field closest to the
present one that holds the bound (a shift of all lines of a document, zero where the bound holds anyway, found by dual
ascent), and the weights move towards them.  So an ordinary line of a bad document may be content, as lines like it are
in good documents, if others there explain the label.  The share that a document needs is the one that parts the
learning documents best.

Forward, backward and Viterbi steps run over many documents at once, line by line.  Learning takes at most ``SAMPLE``
labelled documents, chosen by the hash of their id and one text an id, to the driver, as line features.  The rest is
one pass over all whole texts without a shuffle.

Cases: null or empty text: no words, base_failed (fewer than 10 words), not kept; lines without words carry no
features but a constant and count for nothing; null or repeated ids are judged like others (of several texts of a
learning id the smallest is learnt from, of several labels the smaller one); without labelled documents of both kinds
all lines are content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import PLAIN, U64, Words, cover, grams, map_arrow, pieces, range_hashes, texts, within, words
from weftline.llm.features import WIDTH, Bins, features

SAMPLE = 6000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
KEEP_SHARE = 0.5  # before anything is learnt
GOOD, BAD = 0.98, 0.2
ASCENT = 1.0
LINE_WIDTH = WIDTH + 1
OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_words long, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Crf:
    """Emission weights (width, 2) over binned line features, transitions (2, 2), start weights, and the share of words
    in content lines that a document needs; 1 is content."""

    bins: Bins | None
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    share: float = KEEP_SHARE


def _ranks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, their lengths, and how many have a line at each position."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    return order, length, alive


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def expectations(score: np.ndarray, first: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each line (lines, 2), expected transitions (2, 2) and starts (2,) summed over all sequences."""
    order, length, alive = _ranks(first)
    at = first[:-1][order]
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    for t, n in enumerate(alive):
        here = at[:n] + t
        if t == 0:
            forward[here] = score[here] + crf.start
        else:
            forward[here] = score[here] + _log_sum(forward[here - 1][:, :, None] + crf.step, 1)
    total = np.zeros(len(order))
    some = length > 0
    total[some] = _log_sum(forward[(at + length - 1)[some]], 1)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        n = alive[t]
        here = at[:n] + t
        after = score[here] + backward[here]
        joint = forward[here - 1][:, :, None] + crf.step + after[:, None, :] - total[:n, None, None]
        pairs += np.exp(joint).sum(axis=0)
        backward[here - 1] = _log_sum(crf.step + after[:, None, :], 2)
    every = np.empty(len(order))
    every[order] = total
    marginal = np.exp(forward + backward - np.repeat(every, np.diff(first))[:, None])
    return marginal, pairs, marginal[at[some]].sum(axis=0)


def viterbi(score: np.ndarray, first: np.ndarray, crf: Crf) -> np.ndarray:
    """The best label of each line."""
    order, length, alive = _ranks(first)
    at = first[:-1][order]
    best, back = score.copy(), np.zeros(score.shape, np.int8)
    for t, n in enumerate(alive):
        here = at[:n] + t
        if t == 0:
            best[here] += crf.start
        else:
            way = best[here - 1][:, :, None] + crf.step
            back[here] = way.argmax(axis=1)
            best[here] = score[here] + way.max(axis=1)
    label = np.zeros(len(score), np.int8)
    some = length > 0
    ends = (at + length - 1)[some]
    label[ends] = best[ends].argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        here = at[: alive[t]] + t
        label[here - 1] = back[here, label[here]]
    return label


def content_share(value: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of ``value`` over the lines of each sequence, by ``weight``; 0 where no line weighs anything."""
    run, all_of = (np.concatenate(([0.0], np.cumsum(v))) for v in (value * weight, weight))
    return (run[first[1:]] - run[first[:-1]]) / np.maximum(all_of[first[1:]] - all_of[first[:-1]], 1e-12)


def best_share(share: np.ndarray, good: np.ndarray) -> float:
    """The least share for which most sequences fall on their side; of equally good ones, the nearest to a half."""
    order = np.argsort(share, kind="stable")
    s, g = share[order], good[order]
    # a cut before position k calls the first k bad
    right = np.concatenate(([0], np.cumsum(~g))) + g.sum() - np.concatenate(([0], np.cumsum(g)))
    cut = np.concatenate(([0.0], (s[:-1] + s[1:]) / 2, [1.0]))
    real = np.concatenate(([False], s[:-1] < s[1:], [False]))
    if not real.any():
        return KEEP_SHARE
    best = np.flatnonzero(real & (right == right[real].max()))
    return float(cut[best[np.argmin(np.abs(cut[best] - KEEP_SHARE))]])


def fit(x: np.ndarray, first: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Crf:
    """Adam on the constrained likelihood; ``good`` by sequence, ``weight`` (words) by line."""
    nothing = Crf(None, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2))
    if not len(x) or good.all() or not good.any():
        return nothing
    bins = Bins(x)
    index = bins.index(x)
    lines = np.diff(first)
    doc = np.repeat(np.arange(len(good)), lines)
    total = np.bincount(doc, weight, len(good))
    pull = weight / np.maximum(total, 1)[doc] * lines[doc]  # one on average, by words
    side = np.where(good, 1.0, -1.0)
    bound = np.where(good, GOOD, BAD)
    dual = np.full(len(good), 2.0)
    crf = Crf(bins, np.zeros((bins.width, 2)), np.zeros((2, 2)), np.zeros(2))
    size = bins.width * 2
    m, v = np.zeros(size + 6), np.zeros(size + 6)
    for t in range(1, STEPS + 1):
        score = crf.emit[index].sum(axis=1) + crf.emit[-1]
        free, free_pairs, free_start = expectations(score, first, crf)
        score[:, 1] += (side * dual)[doc] * pull
        held, held_pairs, held_start = expectations(score, first, crf)
        missing = side * (bound - content_share(held[:, 1], weight, first))
        dual = np.where(total > 0, np.maximum(dual + ASCENT * missing, 0.0), 0.0)
        gradient = np.concatenate(
            [bins.add(index, free - held).ravel(), (free_pairs - held_pairs).ravel(), free_start - held_start]
        ) / len(x)
        flat = np.concatenate([crf.emit.ravel(), crf.step.ravel(), crf.start])
        gradient += RIDGE * flat
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        flat = flat - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        crf.emit, crf.step, crf.start = flat[:size].reshape(-1, 2), flat[size : size + 4].reshape(2, 2), flat[size + 4 :]
    label = viterbi(bins.score(x, crf.emit), first, crf)
    some = total > 0
    crf.share = best_share(content_share(label == 1, weight, first)[some], good[some])
    return crf


@dataclass
class Lines:
    """The lines of some documents: features, words of each, first line of each document, and repeated lines."""

    x: np.ndarray
    words: np.ndarray
    first: np.ndarray
    again: np.ndarray
    found: Words


def _seen_before(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """True where an equal code stood earlier in the same group."""
    order = np.lexsort((np.arange(len(code)), code, group))
    g, c = group[order], code[order]
    out = np.zeros(len(code), bool)
    if len(code):
        out[order[1:]] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    return out


def lines_of(data: np.ndarray, cuts: np.ndarray) -> Lines:
    """Lines of the documents that begin at ``cuts[:-1]``; an empty document has one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((cuts[:-1], breaks + 1)), kind="stable")
    # a document's lines begin at its start and after each of its breaks, also after one at its very end
    first = np.searchsorted(breaks, cuts) + np.arange(len(cuts))
    edges = np.append(starts, len(data))
    found = words(data, edges, PLAIN)
    n = np.diff(found.first)
    ends = edges[1:] - (np.append(data, 0)[np.maximum(edges[1:] - 1, 0)] == 0x0A) * (edges[1:] > edges[:-1])
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(first))
    code = range_hashes(data, starts, ends, PLAIN.code)
    again = np.zeros(len(n), bool)
    real = np.flatnonzero(n > 0)
    again[real] = _seen_before(doc[real], code[real])
    x = np.hstack([features(data, edges, found), again[:, None]])
    return Lines(x, n, first, again, found)


def _base(data: np.ndarray, cuts: np.ndarray, lines: Lines) -> dict[str, np.ndarray]:
    found = lines.found
    by_doc = found.first[lines.first]  # first word of each document
    head = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(head)))
    per_word = np.concatenate(([0], np.cumsum(chars[found.end] - chars[found.start])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    again = np.concatenate(([0], np.cumsum(lines.again)))
    ok = within(by_doc, 5, len(found.code))
    hit = np.zeros(len(found.code), bool)
    if ok.any():
        at = np.flatnonzero(ok)
        doc = np.searchsorted(by_doc, at, "right") - 1
        code = grams(found.code, 5)[at]
        order = np.lexsort((code, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = cover(at[twice], 5, len(found.code))
    repeated = np.concatenate(([0], np.cumsum(hit)))
    sums = {"n_words": np.arange(len(found.code) + 1), "word_chars": per_word, "n_repeat_words": repeated}
    out = {name: run[by_doc[1:]] - run[by_doc[:-1]] for name, run in sums.items()}
    out["n_symbols"] = symbols[cuts[1:]] - symbols[cuts[:-1]]
    out["n_dup_lines"] = again[lines.first[1:]] - again[lines.first[:-1]]
    return {k: v.astype(np.int64) for k, v in out.items()}


def judge(data: np.ndarray, cuts: np.ndarray, crf: Crf) -> dict[str, np.ndarray]:
    """Base counts, base_failed, words in content lines, and kept, for each document."""
    lines = lines_of(data, cuts)
    out = _base(data, cuts, lines)
    if crf.bins is None:
        label = np.ones(len(lines.words), np.int8)
    else:
        label = viterbi(crf.bins.score(lines.x, crf.emit), lines.first, crf)
    run = np.concatenate(([0], np.cumsum(lines.words * (label == 1))))
    out["content_words"] = run[lines.first[1:]] - run[lines.first[:-1]]
    n = out["n_words"]
    out["base_failed"] = (n < 10) | (100 * out["n_repeat_words"] > 20 * n)
    out["kept"] = ~out["base_failed"] & (out["content_words"] >= crf.share * n)
    return out


def _line_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    data, offsets = texts(batch.column("text"))
    for i, j in pieces(offsets):
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        lines = lines_of(part, cuts)
        x = np.hstack([lines.x, lines.words[:, None]]).astype(np.float32)
        yield {
            "doc_id": batch.column("doc_id").slice(i, j - i),
            "good": batch.column("good").slice(i, j - i),
            "x": pa.array([x[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)], pa.binary()),
        }


def learn_from(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Crf:
    order = F.md5(F.concat(F.lit("crf"), F.col("doc_id").cast("string")))
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    few = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("good")).orderBy(order, "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    rows = map_arrow(chosen.select("doc_id", "good", "text"), _line_rows, "doc_id long, good int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return learn([np.frombuffer(r["x"], np.float32).reshape(-1, LINE_WIDTH + 1) for r in rows], [r["good"] == 1 for r in rows])


def learn(documents: list[np.ndarray], good: list[bool]) -> Crf:
    """A field from the lines of documents (features, and words last) and their labels."""
    first = np.concatenate(([0], np.cumsum([len(p) for p in documents]))).astype(np.int64)
    x = np.concatenate([np.zeros((0, LINE_WIDTH + 1), np.float32), *documents]).astype(float)
    return fit(x[:, :-1], first, np.array(good, bool), x[:, -1])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_from(docs, labels))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = texts(batch.column("text"))
        for i, j in pieces(offsets):
            out = judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept")
            yield {"doc_id": batch.column("doc_id").slice(i, j - i)} | {k: pa.array(out[k]) for k in names}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, OUT)
