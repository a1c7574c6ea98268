"""Lexical (BM25), vector and fused retrieval, batched over many queries.

``scope`` names the columns that separate indexes: ``["patient_id"]`` gives every patient
an index of their own, ``[]`` is one index over all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carelattice.functions.text import js_round, search_tokens
from carelattice.session import cut_lineage

# --- fixed values -----------------------------------------------------------
LEXICAL_K, VECTOR_K, VECTOR_FLOOR, RRF_K = 8, 8, 0.25, 60
REMOTE_K, REMOTE_MIN_K, REMOTE_MAX_K = 12, 1, 50
ALERT_K, ALERT_BOOST, SNIPPET_LENGTH = 6, 2.0, 240
EMBED_BATCH = 25
SOURCE_DOC, BARE_SOURCE_DOC, EVENT_DOC = "doc_src_", "doc_src_meta_", "doc_evt_"
# --- end of fixed values ----------------------------------------------------

_MARKER = "\u0000"  # cannot occur in a token
INDEX_BUCKETS = 64
VECTOR_PART, QUERY_BLOCK = 4096, 1024  # vectors and queries that meet in one task, about


# -- documents ---------------------------------------------------------------------------------

def source_type_label(source_type: Column) -> Column:
    return (F.when(source_type == "emr", "EMR").when(source_type == "voice", "Voice")
            .when(source_type == "doctor_note", "Clinician note").otherwise("Manual"))


def event_text(df: DataFrame) -> Column:
    def some(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    parts = [F.col("kind"), F.col("label"), F.col("value"), some("unit"), some("status")]
    if "metadata" in df.columns:
        parts.append(F.to_json("metadata"))
    return F.concat_ws(" ", *parts)


def evidence_documents(sources: DataFrame, events: DataFrame) -> DataFrame:
    """One document per source (its text, else title and type) and one per event."""
    has_text = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    src = sources.select(
        "patient_id", F.concat(F.when(has_text, SOURCE_DOC).otherwise(BARE_SOURCE_DOC), "source_id").alias("doc_id"),
        "source_id", F.lit(None).cast("string").alias("event_id"), "source_type", "title",
        F.when(has_text, F.col("raw_text")).otherwise(
            F.concat_ws(" ", F.col("title"), source_type_label(F.col("source_type")))).alias("text"),
        F.col("captured_at").alias("observed_at"))
    evt = events.select(
        "patient_id", F.concat(F.lit(EVENT_DOC), "event_id").alias("doc_id"), "source_id", "event_id",
        F.lit("event").alias("source_type"), F.col("label").alias("title"), event_text(events).alias("text"), "observed_at")
    return src.unionByName(evt)


def documents_of_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    return docs.join(sources.select("patient_id", "source_id").distinct(), ["patient_id", "source_id"], "left_semi")


def documents_of_events(docs: DataFrame, event_ids: DataFrame) -> DataFrame:
    return docs.join(event_ids.select("patient_id", "event_id").distinct(), ["patient_id", "event_id"], "left_semi")


def tokenized(docs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, doc_id, tokens, doc_len); the title is indexed with the text."""
    toks = search_tokens(F.concat_ws(" ", "title", "text"))
    t = docs.select(*scope, "doc_id", *(["event_id"] if "event_id" in docs.columns else []), toks.alias("tokens"))
    return t.withColumn("doc_len", F.size("tokens"))


def postings(tok: DataFrame, scope: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(scope, term, doc_id, tf, doc_len).  With ``terms`` only those terms leave the scan stage."""
    # outer, since Spark would make the tokens a second time for the condition that a plain explode adds below itself
    long = tok.select(*scope, "doc_id", "doc_len", F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    if terms is not None:
        long = long.join(terms, [*scope, "term"], "left_semi")
    return long.groupBy(*scope, "term", "doc_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posts: DataFrame, scope: list[str]) -> DataFrame:
    return posts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(tok: DataFrame, scope: list[str]) -> DataFrame:
    """documents, distinct terms and event documents per index."""
    has_event = F.col("event_id").isNotNull() if "event_id" in tok.columns else F.lit(False)
    docs = tok.groupBy(*scope).agg(F.count(F.lit(1)).alias("documents"), F.count_if(has_event).alias("event_documents"),
                                   F.sum("doc_len").alias("tokens"))
    terms = tok.select(*scope, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(*scope).agg(
        F.count_distinct("term").alias("terms"))
    if scope:
        return docs.join(terms, scope, "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    return docs.withColumn("terms", terms.select("terms").scalar())


# -- BM25 --------------------------------------------------------------------------------------

def bm25_rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf / (tf + 0.5 + 1.5 * (doc_len / avg_len))


def bm25_contribution(tf: Column, df: Column, n: Column, doc_len: Column, avg_len: Column) -> Column:
    return bm25_rarity(df, n) * bm25_weight(tf, doc_len, avg_len)


def query_terms(queries: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, query_id, term, q_tf); a term repeated in a query counts again."""
    return queries.select(*scope, "query_id", F.explode(search_tokens(F.col("query_text"))).alias("term")).groupBy(
        *scope, "query_id", "term").agg(F.count(F.lit(1)).alias("q_tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = LEXICAL_K, scope: list[str] | None = None) -> DataFrame:
    """Top ``k`` documents per query: (scope, query_id, doc_id, score, matched_terms, rank), by one pass over the texts.

    ``queries`` has the scope columns, query_id and query_text.  Ties go to the smaller doc_id.  For many searches of one
    corpus, build_index() once and use search_index().
    """
    scope = scope or []
    q = cut_lineage(query_terms(queries, scope))
    # every document adds a marker posting, so document count and mean length come from the same stored rows as the
    # postings of the query terms
    tok = tokenized(docs, scope)
    marked = tok.select(*scope, "doc_id", "doc_len", F.array_append("tokens", F.lit(_MARKER)).alias("tokens"))
    wanted = q.select(*scope, "term").union(q.select(*scope, F.lit(_MARKER).alias("term"))).distinct()
    stored = cut_lineage(postings(marked, scope, wanted))
    sizes = stored.filter(F.col("term") == _MARKER).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
    return _scored(stored.filter(F.col("term") != _MARKER), sizes, q, k, scope)


def _scored(posts: DataFrame, sizes: DataFrame, q: DataFrame, k: int, scope: list[str]) -> DataFrame:
    """Best ``k`` documents of each query from stored postings.  Scores are summed without the terms, which are
    gathered for the best documents alone."""
    p = posts.join(cut_lineage(document_frequency(posts, scope)), [*scope, "term"])
    if scope:
        p = p.join(sizes, scope)
    else:
        p = p.withColumn("n", sizes.select("n").scalar()).withColumn("avg_len", sizes.select("avg_len").scalar())
        # all terms of a document in one task: its scores need no further shuffle, and of a task's documents only the best leave it
        p = p.repartition("doc_id")
    part = bm25_contribution(F.col("tf"), F.col("df"), F.col("n"), F.col("doc_len"), F.col("avg_len"))
    p = p.select(*scope, "term", "doc_id", part.alias("part"))
    scored = (p.join(q, [*scope, "term"]).groupBy(*scope, "query_id", "doc_id")
              .agg(F.sum(F.col("part") * F.col("q_tf")).alias("score")))
    best = cut_lineage(top_k(scored, [*scope, "query_id"], k))
    asked = best.select(*scope, "query_id", "doc_id").join(q.select(*scope, "query_id", "term"), [*scope, "query_id"])
    matched = (posts.select(*scope, "doc_id", "term").join(asked, [*scope, "doc_id", "term"])
               .groupBy(*scope, "query_id", "doc_id").agg(F.array_sort(F.collect_set("term")).alias("matched_terms")))
    return best.join(matched, [*scope, "query_id", "doc_id"]).select(*scope, "query_id", "doc_id", "score", "matched_terms", "rank")


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, scope: list[str] | None = None, buckets: int = INDEX_BUCKETS) -> None:
    """Writes the postings, laid out by a hash of the term, and the document count and mean length of each index."""
    scope = scope or []
    tok = tokenized(docs, scope)
    (postings(tok, scope).withColumn("bucket", _term_bucket(buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    tok.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/sizes")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = LEXICAL_K, scope: list[str] | None = None) -> DataFrame:
    """bm25() over a built index: only the partitions of the query terms are read."""
    scope = scope or []
    q = cut_lineage(query_terms(queries, scope))
    sizes = spark.read.parquet(f"{path}/sizes")
    buckets = sizes.agg(F.max("buckets")).first()[0] or 1
    # at most ``buckets`` small integers reach the driver
    asked = [r.bucket for r in q.select(_term_bucket(buckets).alias("bucket")).distinct().collect()]
    posts = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(asked))
    posts = cut_lineage(posts.join(q.select(*scope, "term").distinct(), [*scope, "term"], "left_semi"))
    return _scored(posts, sizes.drop("buckets"), q, k, scope)


def _with_sizes(rows: DataFrame, sizes: DataFrame, scope: list[str]) -> DataFrame:
    if scope:
        return rows.join(sizes, scope)
    return rows.withColumn("n", sizes.select("n").scalar()).withColumn("avg_len", sizes.select("avg_len").scalar())


def build_bounded_index(docs: DataFrame, path: str, scope: list[str] | None = None, parts: int = INDEX_BUCKETS) -> None:
    """Writes the postings by parts of documents, how often a term occurs in a part and its largest weight there, and the number and
    mean length of documents.  A score is a weight times the term's rarity, which the counts give for the terms of a query.

    Texts are dealt by part once; a document's tokens are made and counted where it comes to, and its postings are stored once."""
    scope = scope or []
    part = F.pmod(F.xxhash64(*scope, "doc_id"), F.lit(parts)).cast("int")
    here = [*scope, "part"]
    tok = tokenized(docs.select(*scope, "doc_id", "title", "text", part.alias("part")).repartition("part"), here)
    marked = tok.select(*here, "doc_id", "doc_len", F.array_append("tokens", F.lit(_MARKER)).alias("tokens"))  # as in bm25()
    postings(marked, here).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    (stored.filter(F.col("term") == _MARKER).groupBy(*scope)
     .agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("doc_len")) / F.sum("tf")).alias("avg_len")).write.parquet(f"{path}/sizes"))
    p = _with_sizes(stored.filter(F.col("term") != _MARKER), docs.sparkSession.read.parquet(f"{path}/sizes"), scope)
    weight = bm25_weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    p.groupBy(*scope, "term", "part").agg(F.count(F.lit(1)).alias("postings"), F.max(weight).alias("most")).write.parquet(f"{path}/bounds")


def search_bounded_index(spark: SparkSession, path: str, queries: DataFrame, k: int = LEXICAL_K, scope: list[str] | None = None) -> tuple[DataFrame, list[int]]:
    """(bm25() over the index, the parts that were read).

    A query's bound in a part is the sum of its terms' largest scores there.  The part with the highest bound is scored first; its
    k-th score is a limit that parts with a lower bound cannot reach, so those are not read for the query, and a part that no
    query needs is not read at all.  Of the scored documents only a query's best are stored; they alone get their terms."""
    scope = scope or []
    group, key = [*scope, "query_id"], [*scope, "term"]
    q = cut_lineage(query_terms(queries, scope))
    terms = cut_lineage(q.select(*key).distinct())  # stored, so that it has a known size and only postings of these leave a scan
    bounds = cut_lineage(spark.read.parquet(f"{path}/bounds").join(terms, key, "left_semi"))
    counted = bounds.groupBy(*key).agg(F.sum("postings").alias("df"))
    q = cut_lineage(_with_sizes(q.join(counted, key), spark.read.parquet(f"{path}/sizes"), scope))
    bound = bm25_rarity(F.col("df"), F.col("n")) * F.col("most") * F.col("q_tf")
    sums = cut_lineage(bounds.join(q, key).groupBy(*group, "part").agg(F.sum(bound).alias("bound")))
    first = W.partitionBy(*group).orderBy(F.col("bound").desc(), "part")
    ranked = sums.withColumn("_r", F.row_number().over(first))

    def rows(some: set[int]) -> DataFrame:
        return spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(sorted(some))).join(terms, key, "left_semi")

    def scores(wanted: DataFrame) -> tuple[DataFrame, set[int]]:
        wanted = cut_lineage(wanted.select(*group, "part"))
        some = {r["part"] for r in wanted.select("part").distinct().collect()}  # as many as the index has at most
        score = F.sum(bm25_contribution(F.col("tf"), F.col("df"), F.col("n"), F.col("doc_len"), F.col("avg_len")) * F.col("q_tf"))
        # a document's postings in one task, as in _scored()
        hit = (rows(some).repartition(*scope, "doc_id").join(q, key).join(wanted, [*group, "part"], "left_semi")
               .groupBy(*group, "doc_id").agg(score.alias("score")))
        return cut_lineage(top_k(hit, group, k)), some

    best, one = scores(ranked.filter("_r = 1"))
    limit = best.filter(F.col("rank") == k).select(*group, F.col("score").alias("limit"))
    open_ = ranked.filter("_r > 1").join(limit, group, "left").filter(F.col("limit").isNull() | (F.round("bound", 9) >= F.round("limit", 9)))
    others, two = scores(open_)
    best = cut_lineage(top_k(best.unionByName(others).drop("rank"), group, k))

    def same(these: DataFrame, those: DataFrame, names: list[str]) -> list[Column]:
        return [*(these[c] == those[c] for c in names), these["doc_id"].eqNullSafe(those["doc_id"])]

    ids = cut_lineage(best.select(*scope, "doc_id").distinct())
    found = rows(one | two)
    found = found.join(ids, same(found, ids, scope), "left_semi").select(*key, "doc_id")
    asked = cut_lineage(best.select(*group, "doc_id").join(q.select(*group, "term"), group))
    matched = (asked.join(found, same(asked, found, key), "left_semi")
               .groupBy(*group, "doc_id").agg(F.array_sort(F.collect_set("term")).alias("matched_terms")))
    out = best.join(matched, same(best, matched, group))
    return out.select(*(best[c] for c in [*group, "doc_id", "score"]), "matched_terms", "rank"), sorted(one | two)


def top_k(hits: DataFrame, group: list[str], k: int, id_col: str = "doc_id") -> DataFrame:
    """rank <= k by score, then id.  Spark limits each group before and after the shuffle.
    Scores equal to nine decimals are ties, since sums depend on the order of addition."""
    w = W.partitionBy(*group).orderBy(F.round("score", 9).desc(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def alert_queries(alerts: DataFrame) -> DataFrame:
    return alerts.select("patient_id", F.col("alert_key").alias("query_id"), F.concat_ws(
        " ", "title", "explanation", F.array_join("questions", " ")).alias("query_text"))


def alert_search(docs: DataFrame, alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Best six documents per alert; known evidence is boosted after the cut, then re-ranked."""
    hits = bm25(docs, alert_queries(alerts), ALERT_K, ["patient_id"])
    hits = hits.join(docs.select("patient_id", "doc_id", "event_id"), ["patient_id", "doc_id"])
    known = evidence.select("patient_id", F.col("alert_key").alias("query_id"), "event_id",
                            F.lit(ALERT_BOOST).alias("boost")).distinct()
    boosted = hits.join(known, ["patient_id", "query_id", "event_id"], "left").withColumn(
        "score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("rank", "boost")
    return top_k(boosted, ["patient_id", "query_id"], ALERT_K)


def evidence_snippets(docs: DataFrame, queries: DataFrame, scope: list[str]) -> DataFrame:
    hits = bm25(docs, queries, ALERT_K, scope).join(docs, [*scope, "doc_id"])
    return hits.select(*scope, "query_id", "rank", "event_id", "source_id", "source_type", "title",
                       F.substring("text", 1, SNIPPET_LENGTH).alias("snippet"), js_round(F.col("score")).alias("score"))


# -- vectors -----------------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double precision and index order."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def clamp_k(k: int | None) -> int:
    return min(max(REMOTE_K if k is None else k, REMOTE_MIN_K), REMOTE_MAX_K)


def upsert_vectors(current: DataFrame, new: DataFrame) -> DataFrame:
    """Last vector per id wins, the original position is kept.  Columns id, vector, seq."""
    both = current.select("id", "vector", "seq").union(new.select("id", "vector", "seq"))
    return both.groupBy("id").agg(F.max_by("vector", "seq").alias("vector"), F.min("seq").alias("seq"))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = VECTOR_K, floor: float = VECTOR_FLOOR) -> DataFrame:
    """Exact nearest vectors per query: (query_id, id, score, rank).

    Vectors are dealt into parts of about VECTOR_PART, queries into blocks of about QUERY_BLOCK; each part meets each
    block in one task, as a matrix product, and gives the k best of every query.  Only hits from the floor on leave a task."""
    parts = max(1, -(-vectors.count() // VECTOR_PART))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    left = vectors.filter(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector")).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def meet(these: pa.Table, block: pa.Table) -> pa.Table:
        widths = [pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0 for t in (these, block)]
        scores = matrix(block.column("vector"), max(widths)) @ matrix(these.column("vector"), max(widths)).T
        rows, columns = [], []
        for i, row in enumerate(np.round(scores, 9)):
            # all that can be among the k best, ties included: ranking below orders them by id
            limit = np.partition(row, len(row) - k)[-k] if len(row) > k else -np.inf
            hit = np.flatnonzero((row >= limit) & (scores[i] >= floor))
            rows.append(np.full(len(hit), i))
            columns.append(hit)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns))
        return pa.table({"query_id": block.column("query_id").take(pa.array(i)), "id": these.column("id").take(pa.array(j)),
                         "score": pa.array(scores[i, j] if len(i) else np.zeros(0))})

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (vectors, "id"))]
    hits = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(
        meet, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(hits, ["query_id"], k, "id")


# -- fusion ------------------------------------------------------------------------------------

def reciprocal_rank_fusion(ranked: DataFrame, group: list[str], k: int = RRF_K) -> DataFrame:
    """Sum of 1/(k + rank) per item; a repeat inside one list adds again.  Columns group..., item_id, rank."""
    return ranked.groupBy(*group, "item_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def fuse(lexical: DataFrame, semantic: DataFrame, group: list[str], limit: int = LEXICAL_K, k: int = RRF_K) -> DataFrame:
    """Fused ranking per query; a query without semantic hits keeps its lexical list unchanged."""
    lex = lexical.select(*group, F.col("doc_id").alias("item_id"), "rank", F.col("score").alias("lex_score"), "matched_terms")
    sem = semantic.select(*group, F.col("doc_id").alias("item_id"), "rank")
    with_sem = sem.select(*group).distinct()
    fused = reciprocal_rank_fusion(
        lex.join(with_sem, group, "left_semi").select(*group, "item_id", "rank").unionByName(sem), group, k)
    fused = fused.join(lex.select(*group, "item_id", "matched_terms"), [*group, "item_id"], "left")
    alone = lex.join(with_sem, group, "left_anti").select(*group, "item_id", F.col("lex_score").alias("score"), "matched_terms")
    every = fused.unionByName(alone.select(*fused.columns)).withColumn(
        "matched_terms", F.coalesce("matched_terms", F.array(F.lit("semantic"))))
    return top_k(every, group, limit, "item_id")


def scoped_vector_top_k(vectors: DataFrame, queries: DataFrame, scope: list[str], k: int = VECTOR_K, floor: float = VECTOR_FLOOR) -> DataFrame:
    """Exact nearest vectors within a scope such as a patient: (scope, query_id, rank, score) and all columns of ``vectors`` but
    the vector.  A scope's vectors meet its own queries only; Spark limits the hits before they are shuffled."""
    asked = queries.filter(F.col("vector").isNotNull()).select(*scope, "query_id", F.col("vector").alias("_asked"))
    scored = vectors.filter(F.col("vector").isNotNull()).join(asked, scope).withColumn("score", dot(F.col("vector"), F.col("_asked")))
    return top_k(scored.filter(F.col("score") >= floor).drop("vector", "_asked"), [*scope, "query_id"], k, "id")


def reference_rows(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """What is embedded: (patient_id, id, ref_type, ref_id, source_id, text) of the chunks of sources and of stored facts.

    ``chunks``: patient_id, source_id, chunk_id, text; ``facts``: clinical facts.  A fact refers to its event, a chunk to itself."""
    def rows(df: DataFrame, kind: str, ref: str, text: Column) -> DataFrame:
        key = F.concat_ws(":", F.lit(kind), F.col("patient_id").cast("string"), ref)
        return df.select("patient_id", key.alias("id"), F.lit(kind).alias("ref_type"), F.col(ref).alias("ref_id"), "source_id", text.alias("text"))

    return rows(chunks, "chunk", "chunk_id", F.col("text")).unionByName(rows(facts, "fact", "event_id", fact_text()))


def evidence_search(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, lexical_k: int = ALERT_K,
                    semantic_k: int | None = None) -> DataFrame:
    """Hybrid retrieval per patient and query over documents, stored facts and chunks.

    ``queries``: patient_id, query_id, query_text; ``vectors``: reference_rows() with their vector; ``query_vectors``: patient_id,
    query_id, vector.  Vector hits are routed to documents by what they refer to before both lists are fused."""
    lexical = bm25(docs, queries, lexical_k, ["patient_id"])
    hits = scoped_vector_top_k(vectors, query_vectors, ["patient_id"], clamp_k(semantic_k))
    return fuse(lexical, semantic_documents(hits, docs), ["patient_id", "query_id"])


def semantic_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Map vector hits (query_id, ref_type, ref_id, source_id, score, rank) to documents: facts by their
    event, chunks by the first document of their source; hits without a document are dropped."""
    by_event = docs.filter(F.col("event_id").isNotNull()).groupBy("patient_id", F.col("event_id").alias("ref_id")).agg(
        F.max("doc_id").alias("doc_id"))
    by_source = docs.filter(F.col("doc_id").startswith("doc_src")).groupBy("patient_id", "source_id").agg(
        F.min("doc_id").alias("doc_id"))
    facts = rows.filter(F.col("ref_type") == "fact").join(by_event, ["patient_id", "ref_id"])
    chunks = rows.filter(F.col("ref_type") != "fact").join(by_source, ["patient_id", "source_id"])
    cols = ["patient_id", "query_id", "doc_id", "score", "rank"]
    hits = facts.select(*cols).unionByName(chunks.select(*cols))
    # several chunks may map to one document: keep each hit and rank by original order
    w = W.partitionBy("patient_id", "query_id").orderBy("rank", "doc_id")
    return hits.withColumn("rank", F.row_number().over(w))


# -- embeddings --------------------------------------------------------------------------------

def fact_text() -> Column:
    def some(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    return F.concat_ws(" ", some("label"), some("normalized_label"), F.col("value"), some("unit"), some("evidence_quote"))


def embed_missing(rows: DataFrame, embedded: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors for rows (id, text) that have none yet, of whole texts: callers pass chunks or fact texts, which a model
    takes in whole.  The caller supplies the model; it gets batches of at most EMBED_BATCH texts inside Arrow-fed tasks."""
    todo = rows.join(embedded.select("id"), "id", "left_anti").filter(F.coalesce(F.col("text"), F.lit("")) != "") \
               .select("id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[at:at + EMBED_BATCH]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": embedder(part["text"].tolist())})

    id_type = rows.schema["id"].dataType.simpleString()
    return todo.mapInPandas(run, f"id {id_type}, vector array<float>")
