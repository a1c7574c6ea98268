"""Mixing documents to target weights of domains, with soft membership.

A softmax classifier, fitted to a bounded sample of the labelled table, gives each document a posterior over the domains.
A document with t tokens and posterior p that is taken at rate r adds r * t * p to the domains' token totals.  The rates
are nonnegative and start at 1; projected gradients on the least squares between expected totals and targets move
them.  A step needs one small aggregate (a total per domain) and changes a rate by a number per domain, so documents are
never gathered; every few steps the rates are stored.  Documents are then repeated by their rate: its whole part, and
once more with the chance of its fraction, by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.llm.toxicity import EDGE, STEP_CHARS
from carelattice.session import cut_lineage

MAX_TRAIN = 20_000    # labelled rows the classifier is fitted to at most, by a hash of doc_id
VOCABULARY = 4_096    # words at most: those with the largest excess in one domain
EXCESS, MIN_DOCS = 4.0, 3
BINS = 8              # parts of each statistic
ROUNDS, SHRINK = 500, 3e-4
STORE_EVERY = 8
CLOSE, STILL = 1e-6, 1e-5  # the descent ends at totals so near the targets, or when a step moves them no more than so, as parts of all tokens
MOST_STEPS = 1_000         # more are an error, not an answer
SYMBOLS = b"#$%&*|<>{}[]@^~_=+\\/!?"
UPPER = bytes(range(65, 91))
DOMAINS = ("clean", "junk", "toxic")


def described(text: str | None) -> tuple[set[str], list[float], int]:
    """The distinct words, statistics and number of words of a whole text; null counts as empty."""
    text, found, count, at = text or "", set(), 0, 0
    while at < len(text):
        cut = at + STEP_CHARS
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        some = text[at:cut].split()
        count += len(some)
        found.update(some)
        at = cut
    data = text.encode()
    size = max(1, len(data))
    share = lambda drop: 1 - len(data.translate(None, drop)) / size
    numbers = [np.log1p(count), len(found) / max(1, count), share(SYMBOLS), share(UPPER), data.count(b"|") / max(1, count), size / max(1, count)]
    return {w.lower().strip(EDGE) for w in found}, numbers, count


@dataclass
class Classifier:
    """Softmax over binary features: words of a vocabulary, and the part of each statistic."""
    domains: tuple[str, ...]
    vocabulary: dict[str, int]
    cuts: list[np.ndarray]
    weights: np.ndarray  # feature x domain, the last row is the intercept

    def features(self, words: set[str], numbers: list[float]) -> list[int]:
        at, out = len(self.vocabulary), [self.vocabulary[w] for w in self.vocabulary.keys() & words]
        for x, cuts in zip(numbers, self.cuts):
            out.append(at + int(np.searchsorted(cuts, x)))
            at += len(cuts) + 1
        return out

    def posterior(self, words: set[str], numbers: list[float]) -> np.ndarray:
        z = self.weights[-1] + self.weights[self.features(words, numbers)].sum(0)
        p = np.exp(z - z.max())
        return p / p.sum()


def softmax_fit(rows: np.ndarray, columns: np.ndarray, domain: np.ndarray, width: int, k: int) -> np.ndarray:
    """Weights (width + 1) x k by accelerated proximal gradients with an L1 penalty; the intercept is free."""
    n = len(domain)
    w = v = np.zeros((width + 1, k))
    if not n:
        return w
    w[-1] = np.log(np.maximum(np.bincount(domain, minlength=k), 0.5) / n)
    v, t, y = w, 1.0, np.eye(k)[domain]
    x, norm = np.ones(width + 1), 1.0
    for _ in range(30):
        z = x[-1] + np.bincount(rows, x[columns], n)
        x = np.append(np.bincount(columns, z[rows], width), z.sum()) / n
        norm = float(np.linalg.norm(x))
        x /= norm
    step = 1.8 / norm
    for _ in range(ROUNDS):
        z = v[-1] + np.stack([np.bincount(rows, v[columns, j], n) for j in range(k)], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - y) / n
        g = np.vstack([np.stack([np.bincount(columns, error[rows, j], width) for j in range(k)], 1), error.sum(0)])
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * SHRINK, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS) -> Classifier:
    """``docs``: doc_id, text; ``labels``: doc_id, domain.  Other domains than those named, nulls, and ids that
    ``docs`` lacks teach nothing; without any labelled text all domains are equally likely."""
    known = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    part = min(1.0, MAX_TRAIN / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) < int(part * (1 << 20))).limit(2 * MAX_TRAIN)  # bounds the broadcast
    sample = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "domain", "text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(described(t.as_py())[0]) for t in batch.column(1)], pa.list_(pa.string()))],
                                             names=["domain", "words"])

    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = max(1, sum(sizes.values()))
    words = sample.select("domain", "text").mapInArrow(listed, "domain string, words array<string>").select("domain", F.explode("words").alias("word"))
    counted = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    rate = F.col("n") / total
    excess = F.greatest(*((F.col(f"n{i}") - rate * sizes.get(d, 0)) / F.sqrt(rate * (1 - rate) * (sizes.get(d, 0) + 1) + 1e-9) for i, d in enumerate(domains)))
    vocabulary = [r.word for r in counted.where((F.col("n") >= MIN_DOCS) & (excess >= EXCESS)).orderBy(excess.desc(), "word").limit(VOCABULARY).collect()]
    place = {w: i for i, w in enumerate(vocabulary)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [described(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(place[w] for w in place.keys() & f[0]) for f in found], pa.list_(pa.int32())),
                                              pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["doc_id", "domain", "ids", "numbers"])

    rows = sample.mapInArrow(featured, "doc_id long, domain string, ids array<int>, numbers array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "domain"]).reset_index(drop=True)
    numbers = np.array([list(x) for x in rows.numbers]).reshape(-1, 6)
    cuts = [np.unique(np.quantile(numbers[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0) for i in range(6)]
    model = Classifier(domains, place, cuts, np.zeros((0, len(domains))))
    width = len(vocabulary) + sum(len(c) + 1 for c in cuts)
    features = [list(ids) + model.features(set(), list(x)) for ids, x in zip(rows.ids, numbers)]
    at = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.array([c for f in features for c in f], dtype=np.int64)
    model.weights = softmax_fit(at, columns, np.array([domains.index(d) for d in rows.domain], dtype=np.int64), width, len(domains))
    return model


def members(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, text_key (a hash of the text), tokens (words of the whole text), p: array of the posterior, by domain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [described(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[2] for f in found], pa.int64()),
                                              pa.array([model.posterior(f[0], f[1]) for f in found], pa.list_(pa.float64()))],
                                             names=["doc_id", "text_key", "tokens", "p"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_key long, tokens long, p array<double>")


def totals(soft: DataFrame, k: int) -> list[float]:
    """The expected token totals of the domains at rate 1."""
    found = soft.agg(*(F.coalesce(F.sum(F.col("tokens").cast("double") * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k))).first()
    return list(found)


def rates(soft: DataFrame, targets: list[float] | None = None, weights: list[float] | None = None) -> tuple[DataFrame, list[float]]:
    """(``soft`` with rate, the expected totals of the domains): tokens and p from members().

    ``targets``: token totals by domain; or ``weights``: shares of the present total.  The least squares count each domain by
    its own scale, and a step moves rates in proportion to the residuals, p weighing them, whatever the length.  The descent goes on
    until the targets are met or the projected gradient is so small that the totals stand still.  A domain
    nobody belongs to cannot reach its target: its residual stays, the others are met."""
    k = len(targets or weights)
    tokens, p = F.col("tokens").cast("double"), lambda i: F.col("p")[i]
    first = soft.agg(*(F.coalesce(F.sum(tokens * p(i)), F.lit(0.0)).alias(f"t{i}") for i in range(k)),
                     *(F.coalesce(F.sum(tokens * p(i) * p(j)), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    totals = np.array([first[f"t{i}"] for i in range(k)])
    goal = np.array(targets if targets is not None else [w * totals.sum() for w in weights], dtype=float)
    gram = np.array([[first[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1.0))
    top = float(np.linalg.eigvalsh(gram * scale[:, None] * scale[None, :])[-1]) if gram.any() else 1.0
    state, rate = soft.withColumn("rate", F.lit(1.0)), F.col("rate")
    moved, step = np.inf, 0
    while np.abs(totals - goal).max() > CLOSE * max(1.0, goal.sum()) and moved > STILL * max(1.0, goal.sum()):
        step += 1
        if step > MOST_STEPS:
            raise RuntimeError(f"the rates have not settled after {MOST_STEPS} steps")
        error = (totals - goal) * scale
        move = (error * scale / max(top, 1e-12)).tolist()
        rate = F.greatest(F.lit(0.0), rate - sum((p(i) * move[i] for i in range(1, k)), p(0) * move[0]))
        if step % STORE_EVERY == 0:
            state, rate = cut_lineage(state.withColumn("rate", rate)), F.col("rate")
        got = state.agg(*(F.coalesce(F.sum(tokens * p(i) * rate), F.lit(0.0)).alias(f"t{i}") for i in range(k))).first()
        before, totals = totals, np.array([got[f"t{i}"] for i in range(k)])
        moved = np.abs(totals - before).max()
    return state.withColumn("rate", rate), totals.tolist()


def copies(rate: Column, *key: str) -> Column:
    """How often a document is taken: the whole part, and one more if a hash of ``key`` falls below the fraction."""
    chance = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a table with quality and toxic: toxic, else junk at quality 0, else clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, targets: list[float] | None = None, weights: list[float] | None = None,
        domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """doc_id, tokens, p, rate, copies, one row per row of ``docs``.

    ``docs``: doc_id and text, ``labels``: doc_id and domain.  Null texts have no tokens and so no influence; a null doc_id is
    treated like any other.  Repeated rows count each.  Empty table: no rows.  Whether a fraction becomes a copy follows from the
    doc_id and the text, so rows with one id, or with none, draw each for its text.  Other columns are not read."""
    soft = cut_lineage(members(docs, train(docs, labels, domains)))
    out, _ = rates(soft, targets, weights)
    return out.withColumn("copies", copies(F.col("rate"), "doc_id", "text_key"))


def grown_targets(soft_totals: list[float], shares: list[float], main: int, growth: float) -> list[float]:
    """Totals with these shares in which domain ``main`` grows by ``growth``; a domain with too little text for its share
    grows as much as ``main``, so nothing is repeated more often than that."""
    total = soft_totals[main] * growth / shares[main]
    return [min(s * total, t * growth) for s, t in zip(shares, soft_totals)]


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """``docs``, each row as often as ``taken`` (doc_id, text_key, copies) says, all columns as they are."""
    once = taken.where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max("copies").alias("copies"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"))
    kept = row.join(once, row.row_id.eqNullSafe(once["_id"]) & (row.row_key == once["_key"]))
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
