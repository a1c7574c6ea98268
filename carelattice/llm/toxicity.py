"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a hashed sample of all documents is the unlabelled side, which holds
toxic ones too, in the share of the class prior.  The risk of a linear classifier is estimated as

    prior * E_P[loss(z)] + max(0, E_U[loss(-z)] - prior * E_P[loss(-z)])

and where the second part falls below zero it is pushed back up, so that the classifier cannot profit from
unlearning the positives among the unlabelled.  Features are the distinct words of a whole text, by a vocabulary that
Spark counts over both sides.  Both sides and the vocabulary are bounded; every document is scored, inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.session import cut_lineage

MAX_POSITIVE = 10_000   # positives at most, by a hash of doc_id
MAX_UNLABELLED = 20_000
VOCABULARY = 8_192      # words at most: those with the largest excess among the positives
MIN_POSITIVE = 3        # positives a word must stand in
PRIOR = 0.1             # where the labels do not show it
EXCESS = 3.0            # standard deviations by which a word must stand in more positives than its share
ROUNDS, SHRINK = 2000, 0.0002
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())  # punctuation around a word
STEP_CHARS = 1 << 20


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text: lower case, without punctuation at their ends."""
    text, found, at = text or "", set(), 0
    while at < len(text):
        cut = at + STEP_CHARS
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        found.update(text[at:cut].lower().split())
        at = cut
    return {w.strip(EDGE) for w in found}


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(map(self.weights.get, self.weights.keys() & words(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def nn_pu(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float, rounds: int = ROUNDS,
          shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a linear classifier over binary features (rows, columns: the places of ones) that lowers
    the non-negative risk with the logistic loss and ``prior * shrink * |weights|``, by proximal gradients with momentum.
    ``positive``: by row; the others are unlabelled.  Without positives or unlabelled rows: no weights, the prior's odds."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    w = v = np.zeros(width)
    c = vc = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return w, c
    part_p, part_u = positive / n_p, ~positive / n_u
    weight = prior * part_p + part_u
    x, norm = np.ones(width + 1), 1.0
    for _ in range(30):  # the steepest curvature, by power iteration
        z = weight * (x[-1] + np.bincount(rows, x[columns], len(positive)))
        x = np.append(np.bincount(columns, z[rows], width), z.sum())
        norm = float(np.linalg.norm(x))
        x /= norm
    step, t = 3 / norm, 1.0  # the logistic loss bends by a quarter at most
    for _ in range(rounds):
        z = vc + np.bincount(rows, v[columns], len(positive))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative_loss = np.logaddexp(0, z)  # loss(-z)
        rest = part_u @ negative_loss - prior * (part_p @ negative_loss)
        negative_slope = part_u * p - prior * part_p * p
        slope = prior * part_p * (p - 1) + negative_slope if rest >= 0 else -negative_slope
        new = v - step * np.bincount(columns, slope[rows], width)
        new = np.sign(new) * np.maximum(np.abs(new) - step * prior * shrink, 0)
        new_c = vc - step * float(slope.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vc = new + (t - 1) / nt * (new - w), new_c + (t - 1) / nt * (new_c - c)
        w, c, t = new, new_c, nt
    return w, c


def _part(count: int, most: int):
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(min(1.0, most / max(1, count)) * (1 << 20))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None) -> Model:
    """``docs``: doc_id, text, all of them unlabelled; ``labels``: doc_id and the label, 1 for confirmed toxic.

    Where the label's zeros are known too, their number only serves to estimate the class prior (unless ``prior`` is
    given).  Null ids, labels and texts teach nothing.  Repeated rows count as often as they come."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).where("label is not null")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    toxic = counts.get(1, 0)
    if prior is None:
        prior = toxic / sum(counts.values()) if toxic and counts.get(0) else PRIOR
    prior = min(max(prior, 1e-3), 0.9)
    positive = known.where((F.col("label") == 1) & _part(toxic, MAX_POSITIVE)).select("doc_id", F.lit(True).alias("positive"))
    positive = positive.limit(2 * MAX_POSITIVE)  # the bound of the broadcast
    unlabelled = docs.where(_part(docs.select("doc_id").count(), MAX_UNLABELLED)).select("text", F.lit(False).alias("positive"))
    sample = cut_lineage(docs.join(F.broadcast(positive), "doc_id").select("text", "positive").union(unlabelled))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(words(t.as_py())) for t in batch.column(0)], pa.list_(pa.string()))],
                                             names=["positive", "words"])

    found = sample.select("text", "positive").mapInArrow(listed, "positive boolean, words array<string>")
    counted = found.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).where((F.col("p") >= MIN_POSITIVE) & (F.length("word") > 0))
    sides = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = max(1, sides.get(True, 0)), max(1, sides.get(False, 0))
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    excess = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    chosen = counted.where(excess >= EXCESS).orderBy(excess.desc(), "word").limit(VOCABULARY)
    vocabulary = [r.word for r in chosen.collect()]
    place = {w: k for k, w in enumerate(vocabulary)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(place[w] for w in place.keys() & words(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["positive", "ids"])

    features = sample.select("text", "positive").mapInArrow(featured, "positive boolean, ids array<int>").toPandas()
    features = features.iloc[sorted(range(len(features)), key=lambda i: (not features.positive[i], tuple(features.ids[i])))]
    sizes = [len(x) for x in features.ids]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns = np.concatenate([np.asarray(x, dtype=np.int64) for x in features.ids]) if sum(sizes) else np.zeros(0, np.int64)
    weights, intercept = nn_pu(rows, columns, features.positive.to_numpy(bool), len(vocabulary), prior)
    return Model({w: float(x) for w, x in zip(vocabulary, weights) if x}, intercept)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), predicted (1 from the threshold on), one row per row of ``docs``.
    Null and empty texts get the score of no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")
