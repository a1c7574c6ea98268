"""Hybrid retrieval over documents, facts and chunks, and the vectors it needs, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelattice.operators import facts as fx
from carelattice.operators import search as se
from carelattice.plans import oracles as o
from carelattice.plans.catalog import DOCS, PATIENT_BM25, _events_sources, register, tokens_sql
from carelattice.session import cut_lineage
from carelattice.sources import chunks as ch

# A caller's embedder for these queries: how often each of some letters is in a text.
LETTERS = "aeiost"


def letters(texts: list[str]) -> list[list[float]]:
    return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


QUESTIONS = ["blood pressure readings of this year", "kidney disease and its medication", "tired or dizzy"]
COUNTS = "[" + ", ".join(f"(length({{0}}) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
REFERENCES = f"""vrow AS (SELECT patient_id, concat('fact:', patient_id, ':', event_id) AS id, 'fact' AS ref_type, event_id AS ref_id, source_id,
   concat_ws(' ', nullif(label, ''), nullif(canonical, ''), value, nullif(unit, ''), nullif(quote, '')) AS text FROM facts
  UNION ALL SELECT patient_id, concat('chunk:', patient_id, ':', source_id, '_0'), 'chunk', concat(source_id, '_0'), source_id, raw_text FROM sources WHERE raw_text <> ''),
vec AS (SELECT *, {COUNTS.format('text')} AS v FROM vrow)"""


def _references(spark, sf):
    """(rows to embed, events, sources)"""
    e, s = _events_sources(spark, sf)
    cut = ch.chunk_documents(s, "source_id", "raw_text").join(s.select("patient_id", "source_id"), "source_id")
    chunks = cut.withColumn("chunk_id", F.concat_ws("_", "source_id", "ordinal"))
    return se.reference_rows(chunks, fx.clinical_facts(e, s)), e, s


@register("evidence_embedding", o.with_(o.GROUND, o.FACTS, REFERENCES) + "SELECT patient_id, id, ref_type, ref_id, source_id, array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ' ') AS vector FROM vec WHERE right(id, 1) <> '7'")
def evidence_embedding(spark, sf):
    """Chunks of sources and texts of facts, those without a vector embedded by a caller's model."""
    rows, _, _ = _references(spark, sf)
    rows = cut_lineage(rows)
    done = rows.filter(F.col("id").endswith("7"))
    out = se.embed_missing(rows, done, letters).join(rows.drop("text"), "id")
    return out.withColumn("vector", F.array_join(F.transform("vector", lambda x: x.cast("bigint").cast("string")), " "))


@register("hybrid_evidence_search", o.with_(o.GROUND, o.FACTS, DOCS, REFERENCES, PATIENT_BM25.split("aq AS (")[0].rstrip().rstrip(","), f"""ask(query_id, query_text) AS {o.values(enumerate(QUESTIONS))},
qs AS (SELECT patient_id, query_id, query_text, {COUNTS.format('query_text')} AS qv FROM (SELECT DISTINCT patient_id FROM he) CROSS JOIN ask),
qt AS (SELECT patient_id, query_id, term, count(*) AS qtf FROM (SELECT patient_id, query_id, unnest({tokens_sql('query_text')}) AS term FROM qs) GROUP BY ALL),
lx AS (SELECT patient_id, query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 0.5::DOUBLE + 1.5::DOUBLE * (dl / al)))) AS score
  FROM qt JOIN ppost USING (patient_id, term) JOIN pdf USING (patient_id, term) JOIN psize USING (patient_id) GROUP BY ALL),
lxk AS (SELECT *, row_number() OVER (PARTITION BY patient_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lx QUALIFY rank <= 6),
hit AS (SELECT * FROM (SELECT q.query_id, vec.*, list_inner_product(v, qv) AS score FROM qs q JOIN vec ON vec.patient_id = q.patient_id) WHERE score >= 0.25
  QUALIFY row_number() OVER (PARTITION BY patient_id, query_id ORDER BY round(score, 9) DESC, id) <= 12),
hr AS (SELECT *, row_number() OVER (PARTITION BY patient_id, query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hit),
sd AS (SELECT patient_id, query_id, doc_id, row_number() OVER (PARTITION BY patient_id, query_id ORDER BY rank, doc_id) AS rank FROM (
  SELECT hr.patient_id, query_id, rank, CASE WHEN ref_type = 'fact' THEN concat('doc_evt_', ref_id) ELSE concat('doc_src_', source_id) END AS doc_id FROM hr)),
fz AS (SELECT patient_id, query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
   SELECT patient_id, query_id, doc_id, rank FROM lxk SEMI JOIN (SELECT DISTINCT patient_id, query_id FROM sd) USING (patient_id, query_id) UNION ALL SELECT patient_id, query_id, doc_id, rank FROM sd) GROUP BY ALL
  UNION ALL SELECT patient_id, query_id, doc_id, score FROM lxk ANTI JOIN (SELECT DISTINCT patient_id, query_id FROM sd) USING (patient_id, query_id))""")
          + "SELECT patient_id, query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY patient_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fz QUALIFY rank <= 8")
def hybrid_evidence_search(spark, sf):
    """Each patient's record is asked the same questions; facts and chunks are found by vector, documents by words."""
    rows, e, s = _references(spark, sf)
    rows = cut_lineage(rows)
    vectors = cut_lineage(rows.drop("text").join(se.embed_missing(rows, rows.limit(0), letters), "id"))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("query_text")) for i, t in enumerate(QUESTIONS))))
    queries = e.select("patient_id").distinct().select("patient_id", asked.alias("q")).select("patient_id", "q.*")
    texts = queries.select(F.concat_ws(":", F.col("patient_id").cast("string"), "query_id").alias("id"), "patient_id", "query_id", F.col("query_text").alias("text"))
    query_vectors = se.embed_missing(texts, texts.limit(0), letters).join(texts.drop("text"), "id")
    docs = cut_lineage(se.evidence_documents(s, e))
    found = se.evidence_search(docs, queries, vectors, query_vectors)
    return found.select("patient_id", "query_id", F.col("item_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")
