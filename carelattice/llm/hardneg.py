"""Hard negatives from exact scores, by matrix products in a residue number system.

Vectors become integers.  A block of anchors and a shard of rows are reduced modulo several small primes and multiplied as
float32 matrices; the residues are centred and the width is cut so that every sum stays below 2**24, so the products are
exact.  As many primes are used as the largest possible score needs, and the Chinese remainder theorem gives the signed
score back.  A first pass, within a label, finds each anchor's best rows (its positives); a second pass over all rows keeps, for each
positive, the best rows of other labels inside its score window.  Shards and blocks meet as pairs, so a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelattice.session import cut_lineage

PRIMES = (251, 241, 239, 233, 229, 227, 223)  # the largest below 2 ** 8: residues within 125 of zero
CHUNK = 1024            # components multiplied at a time: CHUNK * 125 ** 2 < 2 ** 24
SHARD, BLOCK = 8192, 2048
TILE = 256              # anchors of a block scored at a time
LARGEST = 1 << 53       # components are integers held in doubles


def quantised(vectors: DataFrame, scale: int = 256, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, label, terms: floor(scale * component) of each.

    Rows with a null id, label or vector, or a component that is null or not finite, are left out.  Components of
    2**53 and more after scaling raise an error, as their floor is not exact."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                          F.col(embedding).cast("array<double>").alias("x"))
    whole = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a scaled component is too large for exact scores")).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", good)).select(
        "vec_id", "label", F.transform("x", whole).alias("terms"))


def residues(x: np.ndarray, prime: int) -> np.ndarray:
    """x modulo the prime as float32, centred on zero."""
    half = prime // 2
    return (np.mod(x + half, prime) - half).astype(np.float32)


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the size of any score between a row of ``a`` and a row of ``b``."""
    if not a.size or not b.size:
        return 0
    wide = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    norms = [float(np.sqrt((x.astype(float) ** 2).sum(1).max())) for x in (a, b)]
    return min(wide, int(norms[0] * norms[1] * (1 + 1e-9)) + 1)


def moduli(bound: int) -> tuple[int, ...]:
    """The primes whose product tells all scores from -bound to bound apart."""
    product, used = 1, 0
    while product <= 2 * bound:
        if used == len(PRIMES):
            raise ValueError(f"scores of up to {bound} are beyond the exact range of {product // 2}")
        product *= PRIMES[used]
        used += 1
    return PRIMES[:used]


class Product:
    """Exact scores of all rows of ``a`` with any rows of ``b``."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.primes = moduli(_bound(a, b))
        self.shape = (len(a), len(b))
        self.left = [residues(a, p) for p in self.primes]
        self.right = [np.ascontiguousarray(residues(b, p).T) for p in self.primes]

    def _modular(self, k: int, rows: slice) -> np.ndarray:
        a, b, p = self.left[k][rows], self.right[k], self.primes[k]
        out = np.zeros((len(a), self.shape[1]), np.float32)
        for at in range(0, a.shape[1], CHUNK):  # every partial sum is an integer below 2 ** 24
            out = np.fmod(out + np.fmod(a[:, at:at + CHUNK] @ b[at:at + CHUNK], p), p)
        return out.astype(np.int64)

    def scores(self, rows: slice) -> np.ndarray:
        """Signed int64 scores by mixed radix: x = r1 + p1 * (t2 + p2 * (t3 + ...))."""
        total, weight = np.zeros((len(range(*rows.indices(self.shape[0]))), self.shape[1]), np.int64), 1
        for k, p in enumerate(self.primes):
            digit = np.mod((self._modular(k, rows) - total) % p * pow(weight, -1, p), p)
            total += digit * weight
            weight *= p
        return np.where(total > weight // 2, total - weight, total)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    whole = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(whole.offsets.to_numpy()) if len(whole) else np.zeros(0, np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes):
        out[np.arange(width)[None, :] < sizes[:, None]] = whole.flatten().to_numpy()
    return out


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest allowed scores, the smaller id first at equal ones (all, if fewer)."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        limit = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= limit]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _meet(rows: DataFrame, anchors: DataFrame, group: list[str], pair: Callable, schema: str) -> DataFrame:
    """Every shard of rows (by their number ``row``) with every block of anchors of its group.  ``pair`` gets both as Arrow tables."""
    counts = [t.groupBy(*group).agg(F.count("*").alias("n")) if group else t.agg(F.count("*").alias("n")) for t in (rows, anchors)]
    most = [t.agg(F.max("n").alias("n")).first()["n"] or 0 for t in counts]
    shards, blocks = max(1, -(-most[0] // SHARD)), max(1, -(-most[1] // BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = anchors.withColumn("block", F.pmod(F.col("anchor_key"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    keys = [*group, "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("terms")).alias("w")).first()["w"] or 0


def _columns(found: list[tuple], names: list[str]) -> pa.Table:
    parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.table({n: pa.array(p.astype(np.int64), pa.int64()) for n, p in zip(names, parts)})


def positives(rows: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """anchor_key, anchor_id, positive_rank, positive_id, positive_score: each anchor's k best other rows of its label."""
    width = _width(rows)

    def pair(shard: pa.Table, block: pa.Table) -> pa.Table:
        ids, keys, own, found = shard["vec_id"].to_numpy(), block["anchor_key"].to_numpy(), block["anchor_id"].to_numpy(), []
        if len(ids) and len(own):
            product = Product(_matrix(block["terms"], width), _matrix(shard["terms"], width))
            for at in range(0, len(own), TILE):
                for i, scores in enumerate(product.scores(slice(at, at + TILE)), at):
                    top = best(scores, ids, ids != own[i], k)
                    found.append((np.full(len(top), keys[i]), np.full(len(top), own[i]), ids[top], scores[top]))
        return _columns(found, ["anchor_key", "anchor_id", "positive_id", "positive_score"])

    met = _meet(rows, anchors, ["label"], pair, "anchor_key long, anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_key").orderBy(F.desc("positive_score"), "positive_id"))
    return met.withColumn("positive_rank", rank).where(F.col("positive_rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positive: int = 5, negative: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_key.

    ``rows`` and ``anchors`` are made by quantised(); rows with an anchor's id are its own and never its positives.  A positive's negatives are
    its ``negative`` best rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score,
    at equal scores the smaller id first.  Repeated rows are found as often as they come; repeated anchors count once, anchors
    of one id with different vectors or labels each for itself (anchor_key).  Vectors of different lengths: what one lacks counts
    as 0.  Scores beyond about 2**54 raise an error.  Either side empty: no rows."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))  # copies of a row go to different shards
    anchors = cut_lineage(anchors.distinct().select(F.xxhash64("vec_id", "label", "terms").alias("anchor_key"), F.col("vec_id").alias("anchor_id"), "label", "terms"))
    width = _width(rows)
    top = positives(rows, anchors, positive)
    listed = top.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"))
    sought = cut_lineage(anchors.join(listed, "anchor_key"))  # ``positive`` of them for an anchor at most

    def pair(shard: pa.Table, block: pa.Table) -> pa.Table:
        ids, labels, found = shard["vec_id"].to_numpy(), shard["label"].to_numpy(), []
        keys, own, kinds = (block[c].to_numpy() for c in ("anchor_key", "anchor_id", "label"))
        if len(ids) and len(own):
            wanted = block["positives"].to_pylist()
            product = Product(_matrix(block["terms"], width), _matrix(shard["terms"], width))
            for at in range(0, len(own), TILE):
                for i, scores in enumerate(product.scores(slice(at, at + TILE)), at):
                    others = np.flatnonzero(labels != kinds[i])
                    some, names, hundred = scores[others], ids[others], 100 * scores[others]
                    for p in wanted[i]:
                        score = p["positive_score"]
                        hit = best(some, names, (hundred >= low * score) & (hundred <= high * score), negative)
                        line = [np.full(len(hit), x) for x in (keys[i], own[i], p["positive_rank"], p["positive_id"], score)]
                        found.append((*line, names[hit], some[hit]))
        return _columns(found, names_)

    names_ = ["anchor_key", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = _meet(rows, sought, [], pair, ", ".join(f"{n} long" for n in names_))
    rank = F.row_number().over(Window.partitionBy("anchor_key", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= negative).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"), "anchor_key")


SQL = """
WITH vectors AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.terms, v.terms) AS BIGINT) AS score
  FROM vectors a, vectors v WHERE a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM scored WHERE same),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WHERE p.positive_rank <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
