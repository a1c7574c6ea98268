"""More runnable queries: rejects and copies among facts, stores written and read back, display, proposals' evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelattice.functions import display
from carelattice.operators import facts as fx
from carelattice.operators import graph as gr
from carelattice.operators import grounding
from carelattice.operators import proposals as pr
from carelattice.operators import search as se
from carelattice.plans import oracles as o
from carelattice.plans.activity import health_events
from carelattice.plans.catalog import (CORPUS, FACT_TRENDS, GRAPH, GRAPH_ALL, POSTS, _bench_queries, _corpus, _events_sources, _stored_graph,
                                        bm25_sql, register)
from carelattice.session import ensure_checkpoint_dir
from carelattice.sources import tables as tb
from carelattice.streaming import incremental


def fresh_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"


# -- facts that are rejected, queued for review, or copies ---------------------------------------

# Every tenth event or so gets one flaw, by its number.
FLAWS = {"uncertain": 13, "negated": 17, "blank": 19, "dateless": 23}


def flawed_events(spark, sf):
    e = health_events(spark, sf)
    hit = lambda name: F.col("seq") % FLAWS[name] == 0
    return e.withColumns({"uncertain": hit("uncertain"), "negated": hit("negated"), "label": F.when(hit("blank"), " ").otherwise(F.col("label")),
                          "observed_at": F.when(~hit("dateless"), F.col("observed_at"))})


JUDGED = f"""judged AS (SELECT patient_id, event_id, source_id, kind, seq, CASE WHEN seq % {FLAWS['blank']} = 0 THEN ' ' ELSE label END AS label,
  CASE WHEN seq % {FLAWS['blank']} = 0 THEN 'Empty label' WHEN seq % {FLAWS['negated']} = 0 THEN 'Negated fact'
   WHEN c < 0.45 THEN 'Low extraction confidence' WHEN seq % {FLAWS['dateless']} = 0 THEN 'Invalid observed date' END AS reject,
  CASE WHEN c < 0.75 OR seq % {FLAWS['uncertain']} = 0 THEN 'Needs review due to uncertainty or medium confidence' END AS review
  FROM (SELECT *, round(confidence - CASE WHEN seq % {FLAWS['uncertain']} = 0 THEN 0.15 ELSE 0 END, 2) AS c FROM cand))"""


@register("rejected_facts", o.with_(o.GROUND, o.FACTS, JUDGED) + "SELECT patient_id, event_id, reject AS reason FROM judged WHERE reject IS NOT NULL")
def rejected_facts(spark, sf):
    v = fx.validate(fx.candidate_facts(flawed_events(spark, sf), _events_sources(spark, sf)[1]))
    return v.filter("not accepted").select("patient_id", "event_id", F.col("review_reason").alias("reason"))


@register("review_queue", o.with_(o.GROUND, o.FACTS, JUDGED) + """SELECT patient_id, 'fact' AS target_type, reject IS NULL AS accepted, coalesce(reject, review) AS reason, 'open' AS status, count(*) AS items
  FROM judged WHERE coalesce(reject, review) IS NOT NULL GROUP BY ALL""")
def review_queue(spark, sf):
    """The rule as it is, over events of which some are uncertain, negated, blank or dateless."""
    v = fx.validate(fx.candidate_facts(flawed_events(spark, sf), _events_sources(spark, sf)[1]))
    items = fx.review_items(v).withColumn("accepted", F.col("target_id").startswith("evt_"))
    return items.groupBy("patient_id", "target_type", "accepted", "reason", "status").agg(F.count(F.lit(1)).alias("items"))


@register("fact_dedup", o.with_(o.GROUND, o.FACTS) + "SELECT patient_id, event_id, source_count FROM facts")
def fact_dedup(spark, sf):
    """Every event comes twice; the first arrival of each fact stays."""
    e, s = _events_sources(spark, sf)
    copies = e.withColumns({"event_id": F.concat("event_id", F.lit("_copy")), "seq": F.col("seq") + 10_000_000_000})
    return fx.clinical_facts(e.unionByName(copies), s).select("patient_id", "event_id", "source_count")


@register("first_chunks", o.with_(o.GROUND, o.FACTS) + "SELECT patient_id, event_id, CASE WHEN source_type = 'voice' THEN concat('chunk_', source_id, '_0') END AS chunk_id, CASE WHEN source_type = 'voice' THEN 100 END AS chunk_end FROM facts")
def first_chunks(spark, sf):
    """Facts of spoken sources point to the first of the source's three chunks."""
    e, s = _events_sources(spark, sf)
    cut = s.filter("source_type = 'voice'").select("patient_id", "source_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    chunks = cut.select("*", F.concat_ws("_", F.lit("chunk"), "source_id", "ordinal").alias("chunk_id"), (F.col("ordinal") * 100).alias("start_offset"),
                        (F.col("ordinal") * 100 + 100).alias("end_offset"))
    return fx.clinical_facts(e, s, chunks=chunks).select("patient_id", "event_id", F.col("provenance.chunk_id").alias("chunk_id"),
                                                         F.col("provenance.end_offset").alias("chunk_end"))


# -- graph -------------------------------------------------------------------------------------

def _conditions(g):
    return g.nodes.filter(F.col("kind") == "condition").select("patient_id", F.col("node_id").alias("query_id"), "node_id")


@register("node_events", GRAPH_ALL + "SELECT m.patient_id, m.entity_key AS node_id, m.event_id, h.label FROM mem m JOIN nodes n ON n.patient_id = m.patient_id AND n.node_id = m.entity_key AND n.kind = 'condition' JOIN he h ON h.patient_id = m.patient_id AND h.event_id = m.event_id")
def node_events(spark, sf):
    g = _stored_graph(spark, sf)
    return gr.events_of_nodes(g, health_events(spark, sf), _conditions(g)).select("patient_id", "node_id", "event_id", "label")


@register("highlighted_events", GRAPH_ALL + "SELECT DISTINCT m.patient_id, m.entity_key AS query_id, m.event_id FROM mem m JOIN nodes n ON n.patient_id = m.patient_id AND n.node_id = m.entity_key AND n.kind = 'condition'")
def highlighted_events(spark, sf):
    g = _stored_graph(spark, sf)
    return gr.focus_events(g, centers=_conditions(g))


@register("nearby_edges", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, GRAPH, """ed AS MATERIALIZED (SELECT patient_id, edge_id, from_node, to_node, relation FROM edges),
seen AS (SELECT patient_id, from_node AS node_id, edge_id, relation, to_node AS neighbor_id FROM ed UNION ALL SELECT patient_id, to_node, edge_id, relation, from_node FROM ed WHERE from_node <> to_node)""", recursive=True)
          + f"""SELECT s.patient_id, s.node_id, s.edge_id, row_number() OVER (PARTITION BY s.patient_id, s.node_id ORDER BY s.edge_id) AS rank FROM seen s
 JOIN nodes c ON c.patient_id = s.patient_id AND c.node_id = s.node_id AND c.kind = 'condition' LEFT JOIN nodes n ON n.patient_id = s.patient_id AND n.node_id = s.neighbor_id
 WHERE s.relation <> 'mentioned_in' OR n.kind = 'source' QUALIFY rank <= {gr.NEARBY_LIMIT}""")
def nearby_edges(spark, sf):
    g = _stored_graph(spark, sf)
    return gr.nearby(g, _conditions(g)).select("patient_id", "node_id", "edge_id", "rank")


@register("cluster_counts", GRAPH_ALL + """SELECT patient_id, CASE kind WHEN 'patient' THEN 'person' WHEN 'condition' THEN 'clinical' WHEN 'symptom' THEN 'signals' WHEN 'lab' THEN 'signals' WHEN 'medication' THEN 'treatment' WHEN 'source' THEN 'evidence' ELSE 'context' END AS cluster,
 count(*) AS nodes FROM nodes GROUP BY ALL""")
def cluster_counts(spark, sf):
    return gr.cluster_counts(_stored_graph(spark, sf))


@register("whole_graph", GRAPH_ALL + "SELECT patient_id, 'node' AS part, node_id AS id FROM nodes UNION ALL SELECT patient_id, 'edge', edge_id FROM edges")
def whole_graph(spark, sf):
    """The dispatch without any focus."""
    nodes, edges = gr.query_graph(_stored_graph(spark, sf))
    return nodes.select("patient_id", F.lit("node").alias("part"), F.col("node_id").alias("id")).unionByName(
        edges.select("patient_id", F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


# -- documents and display ---------------------------------------------------------------------

@register("documents_of_medications", o.with_(o.HE) + "SELECT patient_id, concat('doc_evt_', event_id) AS doc_id, label AS title FROM he WHERE kind = 'medication'")
def documents_of_medications(spark, sf):
    e, s = _events_sources(spark, sf)
    docs = se.evidence_documents(s, e)
    return se.documents_of_events(docs, e.filter("kind = 'medication'")).select("patient_id", "doc_id", "title")


@register("event_lines", o.with_(o.HE) + """SELECT event_id, concat('- [', kind, '] ', label, CASE WHEN value IS NOT NULL THEN concat(': ', value) ELSE '' END, CASE WHEN coalesce(unit, '') <> '' THEN concat(' ', unit) ELSE '' END) AS line,
 strftime(observed_at, '%b %-d, %Y') AS day, strftime(observed_at, '%b %-d, %Y, %-I:%M %p') AS moment, 2026 - 1950 - CASE WHEN strftime(observed_at, '%m%d') > '0801' THEN 1 ELSE 0 END AS age FROM he""")
def event_lines(spark, sf):
    """Events as lines with display dates; the age is that of somebody born on the event's day of 1950, on the first of August 2026."""
    e = health_events(spark, sf)
    born = F.make_date(F.lit(1950), F.month("observed_at"), F.dayofmonth("observed_at"))
    return e.select("event_id", display.event_line().alias("line"), display.format_date(F.col("observed_at")).alias("day"),
                    display.format_datetime(F.col("observed_at")).alias("moment"), display.age_years(born, F.lit("2026-08-01").cast("date")).alias("age"))


@register("fact_texts", o.with_(o.GROUND, o.FACTS) + "SELECT patient_id, event_id, concat_ws(' ', nullif(label, ''), nullif(canonical, ''), value, nullif(unit, ''), nullif(quote, '')) AS text, concat(kind, ':', lower(canonical)) AS canonical_key FROM facts")
def fact_texts(spark, sf):
    e, s = _events_sources(spark, sf)
    return fx.clinical_facts(e, s).select("patient_id", "event_id", se.fact_text().alias("text"),
                                          grounding.canonical_key(F.col("kind"), F.col("normalized_label")).alias("canonical_key"))


@register("cited_parts", """WITH a AS (SELECT doc_id AS answer_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g') AS head FROM documents)
SELECT answer_id, (pos + CASE WHEN head = '' THEN 0 ELSE 1 END)::INT AS part, kind AS type, value, citation FROM (
 SELECT answer_id, head, -1 AS pos, 'text' AS kind, head AS value, NULL::INT AS citation FROM a WHERE head <> ''
 UNION ALL SELECT answer_id, head, 0, 'cite', concat('[', answer_id % 7, ']'), (answer_id % 7)::INT FROM a UNION ALL SELECT answer_id, head, 1, 'text', ' and ', NULL FROM a
 UNION ALL SELECT answer_id, head, 2, 'cite', concat('[', answer_id % 3, ']'), (answer_id % 3)::INT FROM a UNION ALL SELECT answer_id, head, 3, 'text', ' end', NULL FROM a)""")
def cited_parts(spark, sf):
    """Answers built from each document's letters with two citations behind them, split again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    head = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")
    text = F.concat(head, F.lit("["), F.col("doc_id") % 7, F.lit("] and ["), F.col("doc_id") % 3, F.lit("] end"))
    return pr.split_answer(docs.select(F.col("doc_id").alias("answer_id"), text.alias("answer")))


# -- proposals' evidence -------------------------------------------------------------------------

@register("trend_evidence", o.with_(o.HE) + """SELECT patient_id, concat('t', seq) AS trend_id, 0 AS pos, event_id, label, kind, source_type FROM he WHERE kind = 'lab'""")
def trend_evidence(spark, sf):
    """One proposed trend for each lab, which names its event and one that does not exist."""
    e, s = _events_sources(spark, sf)
    none = F.lit(None).cast("string")
    p = e.filter("kind = 'lab'").select("patient_id", F.concat(F.lit("t"), "seq").alias("trend_id"), F.col("label").alias("metric"), none.alias("direction"),
                                        none.alias("severity"), none.alias("specialty"), none.alias("reason"), F.array("event_id", F.lit("gone")).alias("evidence_event_ids"))
    return pr.trend_evidence(pr.checked_trends(p, e)[1], e, s)


@register("proposed_edge_evidence", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, GRAPH, """pn AS (SELECT patient_id, min(node_id) AS a, max(node_id) AS b FROM nodes WHERE kind = 'condition' GROUP BY 1 HAVING min(node_id) <> max(node_id))""", recursive=True)
          + "SELECT DISTINCT pn.patient_id, concat(a, '|', b, '|possibly_related_to') AS edge_id, m.event_id FROM pn JOIN mem m ON m.patient_id = pn.patient_id AND (m.entity_key = pn.a OR m.entity_key = pn.b)")
def proposed_edge_evidence(spark, sf):
    g = _stored_graph(spark, sf)
    ends = g.nodes.filter("kind = 'condition'").groupBy("patient_id").agg(F.min("node_id").alias("from_node"), F.max("node_id").alias("to_node")).filter("from_node <> to_node")
    edges = ends.withColumn("relation", F.lit("possibly_related_to")).withColumns({"edge_id": gr.edge_id(), "from_label": F.col("from_node"), "to_label": F.col("to_node")})
    return pr.proposed_edge_evidence(edges, g.node_events, health_events(spark, sf))


# -- stores ------------------------------------------------------------------------------------

def _stored(e, version: str):
    return e.select(F.concat("event_id", F.lit("")).alias("id"), F.col("patient_id").cast("string").alias("user_id"), F.col("kind").alias("type"),
                    F.lit(version).alias("title"), F.col("seq").alias("written"))


@register("stored_sources", o.with_(o.HE) + """SELECT event_id AS id, CAST(patient_id AS VARCHAR) AS user_id, CASE WHEN seq % 3 = 0 THEN 'second' ELSE 'first' END AS title FROM he WHERE patient_id <> (SELECT min(patient_id) FROM he)""")
def stored_sources(spark, sf):
    """Rows written, every third written again, one patient deleted, all read back from the store."""
    e, root = health_events(spark, sf), fresh_folder(spark)
    tb.upsert(root, "sources", _stored(e, "first"), "written", buckets=8)
    tb.upsert(root, "sources", _stored(e.filter("seq % 3 = 0"), "second").withColumn("written", F.col("written") + 10_000_000_000), "written", buckets=8)
    first = str(e.agg(F.min("patient_id")).first()[0])
    tb.delete_user(spark, root, first, 8)
    return spark.read.parquet(f"{root}/sources").select("id", "user_id", "title")


@register("edges_between", GRAPH_ALL + """SELECT CAST(x.patient_id AS VARCHAR) AS user_id, x.edge_id AS id FROM edges x JOIN ent a ON a.patient_id = x.patient_id AND a.entity_key = x.from_node JOIN ent b ON b.patient_id = x.patient_id AND b.entity_key = x.to_node""")
def edges_between(spark, sf):
    """Stored edges both of whose ends are stored entities."""
    g = _stored_graph(spark, sf)
    user = F.col("patient_id").cast("string").alias("user_id")
    edges = g.edges.select(user, F.col("edge_id").alias("id"), F.col("from_node").alias("from_entity_id"), F.col("to_node").alias("to_entity_id"))
    known = g.nodes.filter(~F.col("kind").isin("patient", "source")).select(user, F.col("node_id").alias("id"))
    return tb.edges_between(edges, known).select("user_id", "id")


@register("incremental_readings", o.with_(o.HE) + "SELECT patient_id, label, count(*) AS readings, arg_max(event_id, seq) AS last_event FROM he WHERE kind IN ('lab', 'vital') GROUP BY 1, 2 HAVING arg_max(event_id, seq) NOT LIKE '%7'")
def incremental_readings(spark, sf):
    """Three batches, the last one replayed, through the incremental job; rows that later batches take back must be gone."""
    e, root = health_events(spark, sf), fresh_folder(spark)

    def derive(rows):
        last = rows.filter(F.col("kind").isin("lab", "vital")).groupBy("patient_id", "label").agg(F.count(F.lit(1)).alias("readings"), F.max_by("event_id", "seq").alias("last_event"))
        return {"readings": last.filter(~F.col("last_event").endswith("7"))}

    for n in (0, 1, 2, 2):
        incremental.apply_batch(e.filter(F.col("seq") % 3 == n), n, root, derive, 8)
    return spark.read.parquet(f"{root}/readings").drop("bucket")


@register("stored_index_topk", o.with_(CORPUS, POSTS, bm25_sql("SELECT item_id AS query_id, text AS query_text FROM benchmark", 8))
          + "SELECT query_id, doc_id, round(score, 6) AS score, matched, rank FROM lexk")
def stored_index_topk(spark, sf):
    """The index is built and stored once, then searched by its terms' partitions."""
    path = fresh_folder(spark)
    se.build_index(_corpus(spark, sf), path)
    hits = se.search_index(spark, path, _bench_queries(spark, sf))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.size("matched_terms").cast("bigint").alias("matched"), "rank")
