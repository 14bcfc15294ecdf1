"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Positives are documents that the labels trust as good; unlabelled are web documents taken whatever their label.  With
the class prior p, the risk of a score g is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): where the second part, the
risk of the negatives hidden in the unlabelled, becomes negative on a batch, its gradient is turned round, which keeps
a flexible score from fitting it below zero.  The score is logistic in one-hot bins of shape features of the whole text.

The prior is estimated from positives and unlabelled rows alone; no label of a bad document is looked at.  The share of
unlabelled rows above a score, over the share of positives above it, is the prior plus what negatives add, so it is an
upper bound at every threshold, and tight where few negatives are left.  The threshold is the one with the least
bound once the sampling error of both shares is added (best-bin estimation).  Rows are scored by a model of the other
half of the sample, so that no row is judged by a model that has seen it.

Learning takes at most ``SAMPLE`` positives and as many unlabelled rows to the driver, chosen by the hash of the id,
one for each id (the least text), as features, not texts.  Scoring is one pass over all texts without a shuffle.

Cases: null and empty texts are scored by their (empty) shape; null or repeated ids are scored like others; without
positives every score (and the prior) is 0, and without other rows 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import PLAIN, crc_of_id, map_arrow, pieces, texts, words
from weftline.llm.features import WIDTH, Bins, features

SAMPLE = 8000
STEPS, BATCH, RATE, RIDGE = 1200, 512, 0.05, 1e-4
ROUNDS, DOUBT = 2, 0.1  # fits for the prior, and the chance that a bound on a share fails
THRESHOLD = 0.3


@dataclass
class Model:
    bins: Bins | None
    weights: np.ndarray
    constant: float = 0.0
    prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.bins is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.bins.score(x, self.weights), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the non-negative risk of a batch by each score; where the hidden part is below zero, the step back on it."""
    # the loss log(1 + e^-g) has the slope sigmoid(g) - 1; that of -g has sigmoid(g)
    hidden = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up_p = prior * (_sigmoid(gp) - 1) / len(gp)
    hid_p, hid_u = -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
    return (up_p + hid_p, hid_u) if hidden >= 0 else (-hid_p, -hid_u)


def bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by held-out scores of positives and of unlabelled rows: the ratio of their shares above the best threshold."""
    p, u = np.sort(positive), np.sort(unlabelled)
    levels = np.unique(p)
    above_p = 1 - np.searchsorted(p, levels, "left") / len(p)
    above_u = 1 - np.searchsorted(u, levels, "left") / len(u)
    error = np.sqrt(np.log(4 / DOUBT) / (2 * len(p))) + np.sqrt(np.log(4 / DOUBT) / (2 * len(u)))
    best = int(np.argmin((above_u + error) / above_p))
    return float(min(1.0, above_u[best] / above_p[best]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: scores across two halves, first of a model that takes it for one half."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 1.0 if len(positive) else 0.0
    prior = 0.5
    for _ in range(ROUNDS):
        scored: tuple[list, list] = ([], [])
        for side in (0, 1):
            model = fit(positive[side::2], unlabelled[side::2], prior)
            scored[0].append(model.scores(positive[1 - side :: 2]))
            scored[1].append(model.scores(unlabelled[1 - side :: 2]))
        prior = bound(np.concatenate(scored[0]), np.concatenate(scored[1]))
    return prior


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Adam steps on the non-negative risk with the logistic loss."""
    if not len(positive) or not len(unlabelled):
        return Model(None, np.zeros(0), 1.0 if len(positive) else 0.0, prior)
    bins = Bins(np.concatenate((positive, unlabelled)))
    ip, iu = bins.index(positive), bins.index(unlabelled)
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(bins.width), np.zeros(bins.width), np.zeros(bins.width), 0
    steps = max(1, max(len(ip), len(iu)) // BATCH)
    for _ in range(-(-STEPS // steps)):
        pp, pu = rng.permutation(len(ip)), rng.permutation(len(iu))
        for bp, bu in zip(np.array_split(pp, steps), np.array_split(pu, steps), strict=True):
            if not len(bp) or not len(bu):
                continue
            gp, gu = w[ip[bp]].sum(axis=1) + w[-1], w[iu[bu]].sum(axis=1) + w[-1]
            rp, ru = slopes(gp, gu, prior)
            gradient = (bins.add(ip[bp], rp[:, None]) + bins.add(iu[bu], ru[:, None]))[:, 0] + RIDGE * w
            t += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(bins, w, prior=prior)


def shapes(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, features) of the documents of a column."""
    data, offsets = texts(batch_text)
    for i, j in pieces(offsets):
        part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, features(part, cuts, words(part, cuts, PLAIN))


def _shape_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i, j, x in shapes(batch.column("text")):
        yield {
            "doc_id": batch.column("doc_id").slice(i, j - i),
            "kind": batch.column("kind").slice(i, j - i),
            "x": pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * WIDTH, pa.int32()), pa.array(x.ravel())),
        }


def learn_from(docs: DataFrame, labels: DataFrame, *, label: str, learns: Column, sample: int = SAMPLE) -> Model:
    """A model from trusted positives and unlabelled documents of the part for which ``learns`` holds."""
    order = F.md5(F.concat(F.lit("pu"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    trusted = labels.filter(learns & (F.col(label) == 1) & F.col("doc_id").isNotNull())
    good = trusted.select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    some = docs.filter(learns & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    few = good.withColumn("kind", F.lit(1)).union(some.withColumn("kind", F.lit(0)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    rows = map_arrow(chosen.select("doc_id", "kind", "text"), _shape_rows, "doc_id long, kind int, x array<double>").collect()
    # by a hash, so that the halves of the sample don't follow the ids
    rows.sort(key=lambda r: (zlib.crc32(b"%d" % r["doc_id"]), r["doc_id"]))
    x = {k: np.array([r["x"] for r in rows if r["kind"] == k]).reshape(-1, WIDTH) for k in (0, 1)}
    return fit(x[1], x[0], estimate_prior(x[1], x[0]))


def score_documents(docs: DataFrame, labels: DataFrame, *, of: int = 5, part: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the estimated prior; labels of held-out rows are not looked at."""
    held_out = F.pmod(crc_of_id(), F.lit(of)) == part
    model = learn_from(docs, labels, label="quality", learns=~held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, j, x in shapes(batch.column("text")):
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "score": pa.array(shared.value.scores(x))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = map_arrow(rows, work, "doc_id long, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), F.lit(model.prior).alias("prior"))
