"""Shape features of text segments (documents or lines), worked out for many segments at once in numpy."""

from __future__ import annotations

import numpy as np

from weftline.llm.common import U64, Words

#: Byte classes.
LOW, UP, DIGIT, SPACE, BREAK, MARK, BANG, STOP, SLASH, OTHER, LEAD, TAIL = range(12)
_CLASS = np.full(256, OTHER)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOW, UP, DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A] = SPACE, BREAK
_CLASS[[ord(c) for c in "#*$%&|<>"]] = MARK
_CLASS[ord("!")] = BANG
_CLASS[[ord(c) for c in ".,;:?"]] = STOP
_CLASS[[ord(c) for c in "/@_=+~^{}[]\\"]] = SLASH
_CLASS[0xC0:], _CLASS[0x80:0xC0] = LEAD, TAIL

NAMES = (
    "log_words", "word_length", "low", "up", "digit", "mark", "bang", "stop", "slash", "other", "lead", "lines",
    "distinct", "distinct_pairs", "ends_stop", "begins_up", "short", "long",
    "again", "bars",
)
WIDTH = len(NAMES)


def _per(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(mask)))
    return (run[first[1:]] - run[first[:-1]]).astype(float)


def _distinct(code: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct codes in each segment (segments in ascending order)."""
    if not len(code):
        return np.zeros(n)
    order = np.lexsort((code, segment)) if n > 1 else np.argsort(code)
    c, s = code[order], segment[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
    return np.bincount(s[new], minlength=n).astype(float)


def features(data: np.ndarray, cuts: np.ndarray, found: Words) -> np.ndarray:
    """(segments, WIDTH) matrix; ``found`` are the words of the segments that ``cuts`` bound."""
    n = len(cuts) - 1
    segment = np.repeat(np.arange(n), np.diff(cuts))
    counts = np.bincount(segment * 12 + _CLASS[data[cuts[0] : cuts[-1]]], minlength=n * 12).reshape(n, 12).astype(float)
    words = np.maximum(np.diff(found.first), 1).astype(float)
    real = np.diff(found.first).astype(float)
    letters = counts.sum(axis=1) - counts[:, SPACE] - counts[:, BREAK] - counts[:, TAIL]
    share = counts / np.maximum(letters, 1)[:, None]
    size = found.end - found.start
    doc = found.doc
    with np.errstate(over="ignore"):
        pair = found.code[:-1] * U64(3) + found.code[1:]
    same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    pairs = np.maximum(real - 1, 1)
    last = data[found.end - 1] if len(doc) else np.zeros(0, np.uint8)
    head = data[found.start] if len(doc) else np.zeros(0, np.uint8)
    return np.stack(
        [
            np.log1p(real),
            letters / words,
            share[:, LOW], share[:, UP], share[:, DIGIT], share[:, MARK], share[:, BANG], share[:, STOP],
            share[:, SLASH], share[:, OTHER], share[:, LEAD],
            (counts[:, BREAK] + 1) / words,
            _distinct(found.code, doc, n) / words,
            np.where(real > 1, _distinct(pair[same], doc[:-1][same], n) / pairs, 1.0),
            _per(_CLASS[last] == STOP, found.first) / words,
            _per(_CLASS[head] == UP, found.first) / words,
            _per(size <= 2, found.first) / words,
            _per(size >= 12, found.first) / words,
            np.bincount(doc[:-1][same & (found.code[:-1] == found.code[1:])], minlength=n) / pairs if len(doc) else np.zeros(n),
            _per((size == 1) & (head == ord("|")), found.first) / words,
        ],
        axis=1,
    )


class Bins:
    """One-hot code of features by quantile bins learnt from a sample, with a constant in the last place."""

    def __init__(self, sample: np.ndarray, bins: int = 8):
        cuts = np.quantile(sample, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
        # extremes matter most: finer at both ends
        ends = np.quantile(sample, [0.01, 0.03, 0.06, 0.94, 0.97, 0.99], axis=0)
        self.edges = [np.unique(np.concatenate((cuts[:, k], ends[:, k]))) for k in range(sample.shape[1])]
        self.starts = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        self.width = int(self.starts[-1]) + 1

    def index(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) positions of the ones."""
        return np.stack([np.searchsorted(e, x[:, k], "right") + self.starts[k] for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Linear score of each row, for weights of shape (width,) or (width, outputs)."""
        return weights[self.index(x)].sum(axis=1) + weights[-1]

    def add(self, index: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Transposed product: sums of the residuals (rows, outputs) by position."""
        out = np.zeros((self.width, residual.shape[1]))
        for k in range(index.shape[1]):
            for o in range(residual.shape[1]):
                out[:, o] += np.bincount(index[:, k], residual[:, o], self.width)
        out[-1] += residual.sum(axis=0)
        return out
