"""Exact top-k by integer inner product with MaxScore.

A vector's components are the postings of its dimensions, a query's components weigh those terms.  A term's contribution
is counted from the least it can be in a shard, so it is never negative and has a bound.  Terms of a query are split by
their bounds: those at the end whose bounds together cannot reach the k-th best score so far are non-essential.  The
postings of the essential terms are traversed for the whole shard; the others are probed, the largest bound first, only for
vectors that can still get in.  Shards (by a hash of the id) and blocks of queries meet as pairs, so a task holds one of
each; the best k of every pair are merged by rank.  Ties are never cut off by a bound, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD = 4096    # vectors in a shard, about
BLOCK = 2048    # queries in a block, about
PROBES = 4      # non-essential terms probed at a time
FOUND = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, terms: floor(scale * component) of each.  Rows with a null id or vector, or a component that is null or not
    finite, are left out; an empty vector is one without terms."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", good)).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("terms"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def search_shard(ids: np.ndarray, postings: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of a shard, the smaller id first at equal scores.  ``postings``: a row for each term, a
    column for each vector, of floats if all sums are exact in them."""
    others = np.flatnonzero(ids != query_id)
    if not len(others):
        return ids[:0], np.zeros(0, np.int64)
    ends = np.stack([postings.max(1) * query, postings.min(1) * query])
    least, bound = ends.min(0), ends.max(0) - ends.min(0)
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add
    base = least.sum()

    def at_least(scores: np.ndarray):
        return np.partition(scores, len(scores) - k)[-k] if len(scores) >= k else -np.inf

    # The first limit: whole scores of the vectors with the largest contribution of the first term.
    first = postings[order[0], others] * query[order[0]] if len(order) else np.zeros(len(others))
    seeds = others if len(others) <= 4 * k else others[np.argpartition(-first, 4 * k)[:4 * k]]
    limit = at_least(query @ postings[:, seeds])
    essential = order[:int(np.searchsorted(-rest, -(limit - base), side="right"))] if np.isfinite(limit) else order
    live = others
    sums = query[essential] @ postings[np.ix_(essential, live)] - least[essential].sum() + base
    at = len(essential)
    while True:
        keep = sums + rest[at] >= limit
        live, sums = live[keep], sums[keep]
        if at == len(order):
            break
        some = order[at:at + PROBES]
        sums = sums + query[some] @ postings[np.ix_(some, live)] - least[some].sum()
        at += len(some)
        limit = max(limit, at_least(sums))  # what is known of a score is below it
    scores = sums.astype(np.int64)
    best = np.lexsort((ids[live], -scores))[:k]
    return ids[live][best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query's k best vectors (all, if there are fewer).

    Both sides are made by quantised(); vectors with a query's id are its own and are left out.  Repeated vectors are found as
    often as they come; repeated queries once, and queries of one id with different vectors each for itself.  Vectors
    of different lengths: what one lacks counts as 0.  Either side empty: no rows."""
    n = vectors.agg(F.count("*").alias("n"), F.max(F.size("terms")).alias("width")).first()
    queries = queries.distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("terms").alias("query_key"), F.col("terms").alias("query"))
    m = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("width")).first()
    shards, blocks = max(1, -(-n.n // SHARD)), max(1, -(-m.n // BLOCK))
    width = max(n.width or 0, m.width or 0)

    def pair(shard: pa.Table, block: pa.Table) -> pa.Table:
        ids, found = shard.column("vec_id").to_numpy(), []
        x, q = _matrix(shard.column("terms"), width), _matrix(block.column("query"), width)
        if len(x) and len(q) and width and float(np.abs(x).max()) * float(np.abs(q).max()) * width < 2 ** 52:
            x, q = x.astype(float), q.astype(float)
        postings = np.ascontiguousarray(x.T)
        for key, own, query in zip(block.column("query_id").to_pylist(), block.column("query_key").to_pylist(), q):
            best, scores = search_shard(ids, postings, key, query, k) if len(ids) else (ids, ids)
            found.append((np.full(len(best), key), np.full(len(best), own), best, scores))
        columns = [np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("query_id", "query_key", "vec_id", "score"), columns)))

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(pair, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.terms, v.terms) AS BIGINT) AS score
  FROM vectors q, vectors v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
