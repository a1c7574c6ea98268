"""Text quality by a sparse ensemble of rules.

Statistics of the whole text are Spark columns.  Small boosted trees over them are fitted on the driver to a bounded
sample of labelled rows; every path from a root is a rule, a conjunction of comparisons.  A logistic model with an L1
penalty over rules and clipped statistics keeps few of them, and the model is compiled to one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000  # labelled rows the model is fitted to at most
TREES, DEPTH, BINS, SHRINK = 24, 3, 64, 0.3
PENALTY = 1e-3
SYMBOLS = "#$%&*|<>{}[]@^~_=+\\/!?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÛÙÑÍÓÚÁ"
STATISTICS = ("chars", "words", "word_length", "distinct_words", "upper", "symbols", "digits", "bars", "marks", "stops", "line_words",
              "repeated_lines")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the STATISTICS of each whole text, all doubles; null counts as empty, shares of nothing are 0."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, whole.alias("whole"), F.split(F.translate(whole, "\n\t\r", "   "), " ").alias("parts"), F.split(whole, "\n").alias("rows"))
    d = lambda c: c.cast("double")
    chars, left = F.length("whole"), lambda drop: F.length(F.translate("whole", drop, ""))
    words = F.size("parts") - F.size(F.filter("parts", lambda w: w == "")).cast("int")
    share = lambda n, of: F.coalesce(d(n) / F.nullif(d(of), F.lit(0.0)), F.lit(0.0))
    out = {
        "chars": d(chars), "words": d(words), "word_length": share(chars, words),
        "distinct_words": share(F.size(F.array_distinct("parts")), F.size("parts")),
        "upper": share(chars - left(UPPER), chars), "symbols": share(chars - left(SYMBOLS), chars), "digits": share(chars - left("0123456789"), chars),
        "bars": share(chars - F.length(F.replace(F.col("whole"), F.lit("|"))), words), "marks": share(chars - F.length(F.replace(F.col("whole"), F.lit("!"))), words),
        "stops": share(chars - F.length(F.replace(F.col("whole"), F.lit("."))), words),
        "line_words": share(words, F.size("rows")), "repeated_lines": 1 - share(F.size(F.array_distinct("rows")), F.size("rows")),
    }
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), *(out[s].alias(s) for s in STATISTICS))


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, bound, above the bound)


@dataclass
class Model:
    """score = logistic(intercept + sum of the weights of the rules that hold + slopes * clipped statistics)"""
    intercept: float
    rules: list[tuple[Rule, float]]
    slopes: list[tuple[int, float, float, float]]  # (statistic, low, high, slope)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, bound, above in rule:
                holds = holds & (F.col(STATISTICS[k]) > bound if above else F.col(STATISTICS[k]) <= bound)
            total = total + F.when(holds, weight).otherwise(0.0)
        for k, low, high, slope in self.slopes:
            total = total + F.greatest(F.least(F.col(STATISTICS[k]), F.lit(high)), F.lit(low)) * slope
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], fitted: np.ndarray) -> None:
    """A regression tree over binned statistics; notes each path and writes the leaves' means to ``fitted``."""
    if path:
        rules.append(path)
    best = (1e-9, None)
    if depth and len(rows) >= 40:
        y = target[rows]
        for k, bounds in enumerate(cuts):
            b = x[rows, k]
            n = np.cumsum(np.bincount(b, minlength=len(bounds) + 1))[:-1]
            s = np.cumsum(np.bincount(b, y, len(bounds) + 1))[:-1]
            ok = (n >= 20) & (len(rows) - n >= 20)
            gain = np.where(ok, s ** 2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - y.sum() ** 2 / len(rows), 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (k, int(gain.argmax())))
    if best[1] is None:
        fitted[rows] = target[rows].mean() if len(rows) else 0
        return
    k, at = best[1]
    below = x[rows, k] <= at
    for part, above in ((rows[below], False), (rows[~below], True)):
        grow(x, cuts, target, part, depth - 1, path + ((k, float(cuts[k][at]), above),), rules, fitted)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, bound, above in rule:
        out &= (x[:, k] > bound) == above
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; columns are scaled to unit deviation inside."""
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / deviation
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1)
    w = v = np.zeros(z.shape[1])
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    c = vc = np.log(prior / (1 - prior))
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(z @ v + vc, -30, 30))) - y
        new = v - step * (z.T @ error) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_c = vc - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vc = new + (t - 1) / nt * (new - w), new_c + (t - 1) / nt * (new_c - c)
        w, c, t = new, new_c, nt
    w = w / deviation
    return w, float(c - mean @ w)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, seed: int = 7) -> Model:
    """No rows or one class only: a constant (one half, or nearly the class)."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else (4.0 if y[0] else -4.0), [], [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        target = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        own: list[Rule] = []
        grow(binned, cuts, target, rows, DEPTH, (), own, np.zeros(len(y)))
        leaves = [r for r in own if not any(o[:len(r)] == r and o != r for o in own)]
        for r in leaves:
            inside = holds(r, x)
            p = 1 / (1 + np.exp(-score[inside]))
            if inside.any():
                score[inside] += SHRINK * np.clip((y[inside] - p).sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
        rules += own
    seen: dict[bytes, Rule] = {}  # of rules that hold for the same rows, the shortest
    for r in sorted(set(rules), key=lambda r: (len(r), r)):
        inside = holds(r, x)
        if inside.any() and not inside.all():
            seen.setdefault(min(inside.tobytes(), (~inside).tobytes()), r)
    kept = list(seen.values())
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    features = np.column_stack([holds(r, x) for r in kept] + [np.clip(x[:, k], low[k], high[k]) for k in range(x.shape[1])]).astype(float)
    w, c = lasso_logistic(features, y, penalty)
    return Model(c, [(r, float(v)) for r, v in zip(kept, w) if v], [
        (k, float(low[k]), float(high[k]), float(v)) for k, v in enumerate(w[len(kept):]) if v])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fits to labelled rows of ``docs`` (doc_id, text): all, or if there are more than ``max_train`` a part of about that
    many, taken by a hash of doc_id.  ``labels``: doc_id and the label, 0 or 1; null labels teach nothing."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    part = min(1.0, max_train / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).limit(2 * max_train)  # bounds the broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = statistics(some, keep=("doc_id", "label")).toPandas().sort_values(["doc_id", "label"])
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["label"].to_numpy(float))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``stats`` with score (0 to 1, higher: better) and predicted (1 or 0)."""
    scored = stats.withColumn("score", model.column())
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
