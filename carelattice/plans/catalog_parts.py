"""Single operators that no larger query shows on its own: kinds, flags, gates, ids, counts and the search branch of the graph query."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelattice.functions import text as tx
from carelattice.lexicon import Lexicon
from carelattice.operators import facts as fx
from carelattice.operators import graph as gr
from carelattice.operators import relationships as rel
from carelattice.operators import risk
from carelattice.operators import search as se
from carelattice.plans import oracles as o
from carelattice.plans.activity import health_events
from carelattice.plans.catalog import (CHUNKS, DOCS, EXTRA, FACT_TRENDS, GRAPH, ORACLES, PATIENT_BM25, SUBGRAPH, _alerts, _bench_queries, _corpus, _events_sources, _messages, _relationships,
                                       _stored_graph, MSG, QUERIES, register, tokens_sql)
from carelattice.plans.catalog_more import fresh_folder
from carelattice.session import cut_lineage
from carelattice.sources import chunks as ch
from carelattice.sources import conversations as cv
from carelattice.sources import notes as nt


@register("node_kinds", o.with_(o.HE) + """SELECT patient_id, CASE kind WHEN 'condition' THEN 'condition' WHEN 'symptom' THEN 'symptom' WHEN 'medication' THEN 'medication' WHEN 'lab' THEN 'lab' WHEN 'vital' THEN 'lab'
  WHEN 'care_task' THEN 'task' WHEN 'barrier' THEN 'barrier' ELSE 'encounter' END AS node_kind, count(*) AS events FROM he GROUP BY ALL""")
def node_kinds(spark, sf):
    return health_events(spark, sf).groupBy("patient_id", gr.node_kind(F.col("kind")).alias("node_kind")).agg(F.count(F.lit(1)).alias("events"))


SYMMETRIC = ", ".join(o.lit(r) for r, _, _, both in Lexicon.default().relation_types if both)


@register("symmetric_relationships", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, recursive=True)
          + f"SELECT patient_id, from_key, to_key, relation, relation IN ({SYMMETRIC}) AS symmetric FROM rels")
def symmetric_relationships(spark, sf):
    return rel.is_symmetric(_relationships(spark, sf)[0]).select("patient_id", "from_key", "to_key", "relation", "symmetric")


@register("relationship_ids", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, o.sid_cte("ri", "rels", "rel", "concat(patient_id, ':', from_key, ':', to_key, ':', relation)", "id"), recursive=True)
          + "SELECT patient_id, from_key, to_key, relation, id FROM ri")
def relationship_ids(spark, sf):
    r = _relationships(spark, sf)[0]
    return r.select("patient_id", "from_key", "to_key", "relation", rel.relationship_id(F.col("from_key"), F.col("to_key")).alias("id"))


@register("chunk_ids", "WITH ch AS (" + CHUNKS + "), " + o.sid_cte("ci", "ch", "chunk", "concat(doc_id, ':', ordinal, ':', start_offset, ':', end_offset)", "chunk_id") + " SELECT doc_id, ordinal, chunk_id FROM ci")
def chunk_ids(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return ch.with_chunk_id(ch.chunk_documents(d, "doc_id", "text"), "doc_id").select("doc_id", "ordinal", "chunk_id")


@register("spoken_gate", o.with_(MSG) + """SELECT conv_id, turn, length(trim(x, E' \\t\\n\\r\\f\\v')) >= 10 AS usable, CASE WHEN length(trim(x, E' \\t\\n\\r\\f\\v')) < 10 THEN 'Note is too short.' END AS reason
  FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('  ', split_part(text, ' ', 1), ' ') ELSE text END AS x FROM msg)""")
def spoken_gate(spark, sf):
    """Every third turn is cut to its first word before the gate."""
    m = _messages(spark, sf)
    short = F.concat(F.lit("  "), F.get(F.split("text", " "), F.lit(0)), F.lit(" "))
    usable, rejects = nt.gate_spoken(m.withColumn("text", F.when(F.col("turn") % 3 == 0, short).otherwise(F.col("text"))))
    return usable.select("conv_id", "turn", F.lit(True).alias("usable"), F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("conv_id", "turn", F.lit(False).alias("usable"), "reason"))


@register("distinct_spellings", o.with_(o.HE, "sp AS (SELECT event_id, [concat(' ', label), upper(label), kind, '', label, upper(kind), unit] AS v FROM he)")
          + """SELECT event_id, array_to_string(list_filter([trim(v[1]), CASE WHEN lower(v[3]) <> lower(v[5]) THEN v[3] END, CASE WHEN lower(coalesce(v[7], '')) NOT IN ('', lower(v[3]), lower(v[5])) THEN v[7] END], lambda x: x IS NOT NULL), '|') AS spellings FROM sp""")
def distinct_spellings(spark, sf):
    """A label, its variants, the kind and the unit of each event, without repeats that differ in case only."""
    e = health_events(spark, sf)
    values = F.array(F.concat(F.lit(" "), "label"), F.upper("label"), F.col("kind"), F.lit(""), F.col("label"), F.upper("kind"), F.coalesce("unit", F.lit("")))
    return e.select("event_id", F.array_join(tx.distinct_strings(values), "|").alias("spellings"))


@register("documents_of_spoken_sources", o.with_(o.HE, o.SOURCES, DOCS) + "SELECT patient_id, doc_id, title FROM ed WHERE source_id IN (SELECT source_id FROM sources WHERE source_type = 'voice')")
def documents_of_spoken_sources(spark, sf):
    e, s = _events_sources(spark, sf)
    return se.documents_of_sources(se.evidence_documents(s, e), s.filter("source_type = 'voice'")).select("patient_id", "doc_id", "title")


PATIENT_POSTS = PATIENT_BM25.split("aq AS (")[0].rstrip().rstrip(",")


@register("evidence_index_stats", o.with_(o.HE, o.SOURCES, DOCS, PATIENT_POSTS) + """SELECT patient_id, (SELECT count(DISTINCT term) FROM ppost p WHERE p.patient_id = t.patient_id) AS terms, count(*) AS documents,
  count(*) FILTER (WHERE event_id IS NOT NULL) AS event_documents, sum(len(tokens))::BIGINT AS tokens FROM ptok t GROUP BY patient_id""")
def evidence_index_stats(spark, sf):
    """Each patient's index of sources and events."""
    e, s = _events_sources(spark, sf)
    return se.index_stats(se.tokenized(se.evidence_documents(s, e), ["patient_id"]), ["patient_id"])


@register("alert_totals", ORACLES["extra_alerts"].replace("SELECT x.patient_id, x.title, arg_min(h.event_id, h.seq) AS event_id", "SELECT x.patient_id, x.title").join(
    ["SELECT patient_id, sum(r)::BIGINT AS rule_alerts, sum(1 - r)::BIGINT AS extra_alerts, CASE WHEN sum(1 - r) > 0 THEN 'rules+extra' ELSE 'rules' END AS method FROM (SELECT patient_id, 0 AS r FROM (",
     f") UNION ALL SELECT patient_id, 1 FROM ({o.with_(o.GROUND, o.TRENDS, o.ALERTS)} SELECT patient_id FROM alerts)) GROUP BY patient_id"]))
def alert_totals(spark, sf):
    """Rule alerts and accepted proposals, counted apart."""
    return risk.alert_totals(_alerts(spark, sf)[0], QUERIES["extra_alerts"](spark, sf).select("patient_id", "title").distinct())


@register("review_totals", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, recursive=True) + """SELECT patient_id, 'fact' AS target_type, count(*) AS open_items FROM cand WHERE confidence < 0.75 GROUP BY 1
 UNION ALL SELECT patient_id, 'relationship', count(*) FROM rels WHERE review_status = 'needs_review' GROUP BY 1""")
def review_totals(spark, sf):
    e, s = _events_sources(spark, sf)
    return fx.review_totals(fx.review_items(fx.validate(fx.candidate_facts(e, s))), rel.review_rows(_relationships(spark, sf)[0]))


QUESTION = "kidney disease and dizzy"
HITS = f"""qt AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({tokens_sql(o.lit(QUESTION))}) AS term) GROUP BY 1),
lx AS (SELECT patient_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 0.5::DOUBLE + 1.5::DOUBLE * (dl / al)))) AS score
  FROM qt JOIN ppost USING (term) JOIN pdf USING (patient_id, term) JOIN psize USING (patient_id) GROUP BY ALL),
lxk AS (SELECT * FROM lx QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY round(score, 9) DESC, doc_id) <= 8),
fe AS (SELECT l.patient_id, 'q' AS query_id, p.event_id FROM lxk l JOIN ptok p ON p.patient_id = l.patient_id AND p.doc_id = l.doc_id WHERE p.event_id IS NOT NULL)"""


@register("search_subgraph", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, GRAPH, DOCS, PATIENT_POSTS, HITS, SUBGRAPH, recursive=True)
          + "SELECT patient_id, query_id, 'node' AS part, node_id AS id FROM subn UNION ALL SELECT patient_id, query_id, 'edge', edge_id FROM sube")
def search_subgraph(spark, sf):
    """What explains the events that a question finds in each patient's record."""
    e, s = _events_sources(spark, sf)
    docs = cut_lineage(se.evidence_documents(s, e))
    queries = e.select("patient_id").distinct().select("patient_id", F.lit("q").alias("query_id"), F.lit(QUESTION).alias("query_text"))
    hits = se.bm25(docs, queries, scope=["patient_id"]).join(docs.select("patient_id", "doc_id", "event_id"), ["patient_id", "doc_id"])
    nodes, edges = gr.query_graph(_stored_graph(spark, sf), search_hits=cut_lineage(hits.select("patient_id", "query_id", "event_id")))
    return (nodes.select("patient_id", "query_id", F.lit("node").alias("part"), F.col("node_id").alias("id"))
            .unionByName(edges.select("patient_id", "query_id", F.lit("edge").alias("part"), F.col("edge_id").alias("id"))))


@register("bounded_index_topk", ORACLES["stored_index_topk"])
def bounded_index_topk(spark, sf):
    """The index keeps each term's largest score by part of the corpus; parts that cannot reach a query's best are not read for it."""
    path = fresh_folder(spark)
    se.build_bounded_index(_corpus(spark, sf), path)
    hits, _ = se.search_bounded_index(spark, path, _bench_queries(spark, sf))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.size("matched_terms").cast("bigint").alias("matched"), "rank")


@register("follow_up_items", o.with_(o.HE) + "SELECT patient_id, source_id, row_number() OVER (PARTITION BY patient_id, source_id ORDER BY seq) AS rank, label FROM he WHERE kind = 'care_task' QUALIFY rank <= 5")
def follow_up_items(spark, sf):
    """Each source of a patient as a conversation."""
    return cv.follow_up_items(health_events(spark, sf), ["patient_id", "source_id"])


@register("linked_relationships", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, recursive=True) + """SELECT patient_id, from_key, to_key, relation FROM rels
 WHERE confidence >= 0.5 AND EXISTS (SELECT 1 FROM ent e WHERE e.patient_id = rels.patient_id AND e.entity_key = to_key)""")
def linked_relationships(spark, sf):
    """Relationships with low confidence, and copies of others, point to entities that nobody has."""
    r, e, _, _ = _relationships(spark, sf)
    lost = F.when(F.col("confidence") < 0.5, "lab:gone").otherwise(F.col("from_key"))
    foreign = r.select("patient_id", lost.alias("from_key"), "to_key", "relation").unionByName(
        r.select("patient_id", "from_key", F.concat(F.lit("gone:"), "to_key").alias("to_key"), "relation"))
    return gr.linked_relationships(foreign, e)
