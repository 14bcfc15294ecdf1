"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes compatibility forms apart, drops marks and signs without width, lower-cases, maps letters of other scripts
that look like Latin ones and digits or signs that stand for letters to those letters, and puts one space between words.  A lexicon entry is a whole word or the beginning of a word (word
stems with changing endings); its weight is the log odds of the entry in toxic against other documents.  An exception
phrase is an entry with the word before or after it which, in the labelled rows, stands in documents that are not
toxic; there the entry does not count.  A word counts once, with its largest weight.  The sum of weights is
normalised by length in three ways (share of words, by the square root of the words, logarithm of the sum), and a
logistic curve over these, fitted on the labelled rows, gives the score.

Learning uses at most ``SAMPLE`` labelled documents, chosen by the hash of their id and one text an id.  Their folded
texts are a table; entries, phrases and sums are counted in tasks, and only counts and three numbers a text reach the
driver.  Scoring is one narrow
pass over all whole texts without a shuffle, with the lexicon (at most ``ENTRIES`` entries) as a broadcast.

Cases: null and empty texts have no words and get the score of a text without hits; null or repeated ids are scored
like others; without labelled rows of both kinds every score is the share of toxic rows, or 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_of_id, map_arrow, written

SAMPLE = 10_000
ENTRIES = 400
THRESHOLD = 0.7
LEAST_GAIN = 12
_BUILT: dict = {}
SHORTEST, LONGEST = 3, 12
#: Letters that look alike, and digits and signs used as letters.
LOOKALIKES = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwкkмmтtнhвbαaοoεeιiρpυuνvκkτt"
SUBSTITUTES = "0o1i3e4a5s7t8b@a$s"
FOLD = {ord(LOOKALIKES[k]): LOOKALIKES[k + 1] for k in range(0, len(LOOKALIKES), 2)} | {
    ord(SUBSTITUTES[k]): SUBSTITUTES[k + 1] for k in range(0, len(SUBSTITUTES), 2)
}
_OTHER = re.compile(r"[\W_]+")
#: Combining marks, and signs without width that may stand inside words.
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")


def fold(text: str | None) -> str:
    """Folded words with a space before, between and after: compatibility forms are taken apart (wide and styled letters,
    ligatures), marks and signs without width dropped, look-alikes and digits read as letters."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return f" {_OTHER.sub(' ', text.lower().translate(FOLD)).strip()} "


@dataclass
class Lexicon:
    """Weighted entries (`` stem`` or `` word ``), exception phrases, and the logistic curve over the normalised sums."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        machine.make_automaton()
        return machine


def matched(machine: ahocorasick.Automaton | None, text: str) -> dict[int, float]:
    """Largest weight for each place (of the space before the word) at which an entry begins."""
    found: dict[int, float] = {}
    if machine is not None:
        for end, (length, weight) in machine.iter(text):
            at = end - length + 1
            if weight > found.get(at, 0.0):
                found[at] = weight
    return found


def phrases(text: str, at: int) -> tuple[str, str]:
    """The word that begins after the space at ``at``, with the word before it and with the one after it."""
    stop = text.index(" ", at + 1)
    before = text.rfind(" ", 0, at) if at else -1
    after = text.find(" ", stop + 1)
    return text[before + 1 : stop] if before >= 0 else "", text[at + 1 : after] if after >= 0 else ""


def sums(text: str, machine: ahocorasick.Automaton | None, exceptions: frozenset[str]) -> tuple[float, int]:
    """(sum of weights, words) of a folded text."""
    words = text.count(" ") - 1 if len(text) > 2 else 0
    total = 0.0
    for at, weight in matched(machine, text).items():
        if exceptions and not exceptions.isdisjoint(phrases(text, at)):
            continue
        total += weight
    return total, words


def normalised(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.maximum(words, 1)
    return np.stack([total / n * 10, total / np.sqrt(n), np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for logistic regression with an intercept in the last place."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _entries(text: str) -> set[str]:
    """Beginnings of the words of a folded text and whole words."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


def _gain(a: int, b: int, n: int, m: int) -> float:
    """Log-likelihood gain of different rates a / n and b / m."""

    def part(k: int, of: int, rate: float) -> float:
        return (k * math.log(rate) if k else 0.0) + ((of - k) * math.log(1 - rate) if of > k else 0.0)

    both = (a + b) / (n + m)
    return part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both)


def choose(counts: Iterable[tuple[str, int, int]], n: int, m: int) -> dict[str, float]:
    """Weighted entries from (entry, toxic documents with it, others with it), of ``n`` toxic documents and ``m`` others."""
    known = {g: (a, b) for g, a, b in counts}
    gains = {g: _gain(a, b, n, m) for g, (a, b) in known.items() if a / n > 4 * (b / m)}
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    # best first; of equal ones the longest; an entry inside a chosen one, or around it, adds nothing new
    for g in sorted(gains, key=lambda g: (-round(gains[g], 6), -len(g), g)):
        if gains[g] < LEAST_GAIN or len(chosen) == ENTRIES:
            break
        stem = g.rstrip()
        if stem in beginnings or any(stem[:k] in chosen for k in range(SHORTEST + 1, len(stem) + 1)):
            continue
        a, b = ((k + 0.5) / (of + 1) for k, of in zip(known[g], (n, m), strict=True))
        chosen[g] = math.log(a / (1 - a)) - math.log(b / (1 - b))
        beginnings.update(stem[:k] for k in range(SHORTEST + 1, len(stem) + 1))
    return chosen


def score(lexicon: Lexicon, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = (normalised(total, words) - lexicon.centre) / lexicon.scale
    return 1 / (1 + np.exp(-np.clip(x @ lexicon.curve[:3] + lexicon.curve[3], -30, 30)))


def learn_from(docs: DataFrame, labels: DataFrame, *, label: str, learns: Column, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from at most ``sample`` labelled documents for which ``learns`` holds, the same ones in every run."""
    known = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label")).filter(learns)
    order = F.md5(F.col("doc_id").cast("string"))
    few = known.groupBy("doc_id").agg(F.min("__label").alias("label")).orderBy(order, "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # of equal folded texts with equal labels one counts
    folded = map_arrow(chosen.select("label", "text"), _folded, "label int, folded string").distinct()
    return learn(written(folded, "toxic-sample"))


def _folded(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {"label": batch.column("label"), "folded": pa.array([fold(t.as_py()) for t in batch.column("text")], pa.string())}


def _tally(items: Callable[[str], Iterable[str]]) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """Arrow step: how many toxic (``a``) and other (``b``) texts of a batch have each of their items."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        seen = (Counter(), Counter())
        for label, text in zip(batch.column("label").to_pylist(), batch.column("folded"), strict=True):
            seen[label == 0].update(set(items(text.as_py())))
        names = list(seen[0].keys() | seen[1].keys())
        yield {"item": pa.array(names, pa.string())} | {k: pa.array([c[g] for g in names], pa.int64()) for k, c in zip("ab", seen, strict=True)}

    return work


def counted(sample: DataFrame, items: Callable[[str], Iterable[str]]) -> DataFrame:
    """``item``, ``a`` and ``b``: toxic and other texts of the sample that have it."""
    tallies = map_arrow(sample, _tally(items), "item string, a long, b long")
    return tallies.groupBy("item").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn(sample: DataFrame) -> Lexicon:
    """A lexicon from the table (label, folded).  Entries, phrases and sums are found in tasks; counts of what can still be
    chosen and three numbers a text reach the driver, never texts."""
    n, m = sample.agg(F.count_if(F.col("label") != 0), F.count_if(F.col("label") == 0)).first()
    if not n or not m:
        rate = n / max(1, n + m)
        return Lexicon(curve=np.array([0, 0, 0, math.log((rate + 1e-6) / (1 - rate + 1e-6))]))

    def part(k: str, of: int, rate: str) -> str:
        return f"({k} * ln(greatest({rate}, 1e-300D)) + ({of} - {k}) * ln(greatest(1 - {rate}, 1e-300D)))"

    both = f"((a + b) / {n + m}D)"
    gain = f"{part('a', n, f'(a / {n}D)')} + {part('b', m, f'(b / {m}D)')} - {part('a', n, both)} - {part('b', m, both)}"
    possible = counted(sample, _entries).filter(f"a >= {max(3, n // 200)} AND a / {n}D > 3.99 * (b / {m}D) AND {gain} >= {LEAST_GAIN - 0.01}")
    lexicon = Lexicon(choose([tuple(r) for r in possible.collect()], n, m))

    def around(text: str) -> list[str]:
        return [p for at in matched(_machine(lexicon), text) for p in phrases(text, at) if p]

    # exceptions: phrases around an entry that only documents of the other kind have
    harmless = counted(sample, around).filter("b >= 5 AND a = 0").select("item").collect()
    lexicon.exceptions = frozenset(r[0] for r in harmless)

    def numbers(batch: pa.RecordBatch) -> Iterator[dict]:
        pairs = [sums(t.as_py(), _machine(lexicon), lexicon.exceptions) for t in batch.column("folded")]
        total, words = zip(*pairs, strict=True)
        yield {"total": pa.array(total, pa.float64()), "words": pa.array(words, pa.int64()), "label": batch.column("label")}

    rows = sorted(tuple(r) for r in map_arrow(sample, numbers, "total double, words long, label int").collect())
    total, words, label = (np.array(x, float) for x in zip(*rows, strict=True))
    x = normalised(total, words)
    lexicon.centre, lexicon.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    lexicon.curve = _logistic((x - lexicon.centre) / lexicon.scale, (label != 0).astype(float))
    return lexicon


def _machine(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """The automaton of a lexicon, built once where it is used."""
    if "machine" not in _BUILT or _BUILT["machine"][0] is not lexicon:
        _BUILT["machine"] = (lexicon, lexicon.automaton())
    return _BUILT["machine"][1]


def scored(docs: DataFrame, lexicon: Lexicon, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the columns of ``carry``) and ``score`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    built: list = []

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        known = shared.value
        if not built:
            built.append(known.automaton())
        rows = batch.column("row")
        column = batch.column("text") if "text" in batch.schema.names else pc.struct_field(rows, "text")
        pairs = [sums(fold(t.as_py()), built[0], known.exceptions) for t in column]
        total, words = (np.array(x, float) for x in zip(*pairs, strict=True))
        yield {"row": rows, "score": pa.array(score(known, total, words))}

    beside = [] if "text" in carry else ["text"]
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), *beside)
    return map_arrow(rows, work, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def held_out(part: int, of: int) -> Column:
    return F.pmod(crc_of_id(), F.lit(of)) == part


def score_documents(docs: DataFrame, labels: DataFrame, *, of: int = 3, part: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; labels of held-out rows are not looked at."""
    lexicon = learn_from(docs, labels, label="toxic", learns=~held_out(part, of))
    out = scored(docs, lexicon, ["doc_id"]).select("row.doc_id", "score")
    return out.select(
        "doc_id", held_out(part, of).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, of: int = 3, part: int = 1) -> DataFrame:
    """The documents with a score below the threshold, with all their columns."""
    lexicon = learn_from(docs, labels, label="toxic", learns=~held_out(part, of))
    return scored(docs, lexicon, docs.columns).filter(F.col("score") < THRESHOLD).select("row.*")
