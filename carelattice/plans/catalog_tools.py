"""The named data tools as registered queries: each calls its table function from SQL over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelattice.operators import entities as ent
from carelattice.operators import risk, tools
from carelattice.plans import oracles as o
from carelattice.plans.catalog import FACT_TRENDS, GRAPH, GRAPH_ALL, METRIC, RISK, TREND_STATS, _alerts, _graph, _relationships, _stored_graph, at, memo, register
from carelattice.plans.catalog_more import fresh_folder

NODE = "lab:hba1c"
NEIGHBORS = """seen AS (SELECT patient_id, from_node AS node_id, edge_id, relation, 'outgoing' AS direction, to_node AS neighbor_id, confidence FROM edges
 UNION ALL SELECT patient_id, to_node, edge_id, relation, 'incoming', from_node, confidence FROM edges WHERE from_node <> to_node)"""


@memo
def _tools(spark, sf):
    alerts, events = _alerts(spark, sf)
    r, m = _relationships(spark, sf)[0], _graph(spark, sf)[1]
    root = fresh_folder(spark)
    tools.store(root, events, alerts, risk.alert_evidence(alerts, events), _stored_graph(spark, sf), ent.entity_aliases(m), r, m)
    return root


def call(spark, sf, sql: str):
    tools.install(spark, _tools(spark, sf))
    return spark.sql(sql)


@register("tool_list_metrics", METRIC.format(
    f"patient_id, label AS metric, count(*) AS readings, arg_min(unit, seq) AS unit, {o.ts('min(observed_at)')} AS first_observed, {o.ts('max(observed_at)')} AS last_observed")
    + " GROUP BY patient_id, label")
def tool_list_metrics(spark, sf):
    m = call(spark, sf, "SELECT * FROM list_metrics()")
    return m.withColumns({"first_observed": at("first_observed"), "last_observed": at("last_observed")})


SINCE, AS_OF = 10, "2024-01-20 00:00:00"


@register("tool_metric_series", METRIC.format(f"patient_id, event_id, {o.ts('observed_at')} AS observed_at, number AS value, unit")
          + f" AND label = 'eGFR' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL {SINCE} DAY")
def tool_metric_series(spark, sf):
    s = call(spark, sf, f"SELECT * FROM get_metric_series('eGFR', since_days => {SINCE}, as_of => TIMESTAMP '{AS_OF}')")
    return s.withColumn("observed_at", at("observed_at"))


@register("tool_compute_trend", f"SELECT * FROM ({TREND_STATS}) WHERE metric = 'eGFR'")
def tool_compute_trend(spark, sf):
    t = call(spark, sf, "SELECT * FROM compute_trend('eGFR')")
    return t.withColumns({"window_start": at("window_start"), "window_end": at("window_end")})


@register("tool_query_events", o.with_(o.HE) + f"""SELECT patient_id, event_id, kind, label, value, unit, {o.ts('observed_at')} AS observed_at, status FROM he
 WHERE kind = 'lab' AND regexp_matches(lower(label), 'a1c|tsh') AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL {SINCE} DAY""")
def tool_query_events(spark, sf):
    e = call(spark, sf, f"SELECT * FROM query_events(type => 'lab', label_pattern => 'A1C|tsh', since_days => {SINCE}, as_of => TIMESTAMP '{AS_OF}')")
    return e.withColumn("observed_at", at("observed_at"))


@register("tool_risk_alerts", RISK + """SELECT a.patient_id, a.alert_key, a.title, a.severity, a.explanation, e.event_id AS evidence_event_id
 FROM alerts a LEFT JOIN (SELECT DISTINCT patient_id, alert_key, event_id FROM ev) e ON e.patient_id = a.patient_id AND e.alert_key = a.alert_key WHERE a.severity IN ('high', 'medium')""")
def tool_risk_alerts(spark, sf):
    return call(spark, sf, "SELECT * FROM get_risk_alerts('medium')")


@register("tool_search_graph", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, GRAPH, """hay AS (SELECT patient_id, node_id, lower(concat(label, ' ', kind)) AS t FROM nodes UNION ALL SELECT patient_id, entity_key, lower(label) FROM mem),
hs AS (SELECT patient_id, node_id, max(contains(t, 'kidney')::INT) + max(contains(t, 'advil')::INT) + max(contains(t, 'lab')::INT) AS score FROM hay GROUP BY 1, 2)""", recursive=True)
          + """SELECT n.patient_id, n.node_id, n.kind, n.label, h.score::INT AS score, row_number() OVER (PARTITION BY n.patient_id ORDER BY h.score DESC, n.node_id) AS rank
 FROM nodes n JOIN hs h USING (patient_id, node_id) WHERE n.kind <> 'source' AND h.score > 0 QUALIFY rank <= 5""")
def tool_search_graph(spark, sf):
    return call(spark, sf, "SELECT patient_id, node_id, kind, label, score, rank FROM search_graph('Kidney or Advil; LAB', 5)")


@register("tool_node_events", GRAPH_ALL + f"""SELECT DISTINCT m.patient_id, h.event_id, h.kind, h.label, h.value, h.unit, {o.ts('h.observed_at')} AS observed_at, h.status FROM mem m
 JOIN he h ON h.patient_id = m.patient_id AND h.event_id = m.event_id WHERE m.entity_key = '{NODE}'""")
def tool_node_events(spark, sf):
    return call(spark, sf, f"SELECT * FROM get_node_events('{NODE}')").withColumn("observed_at", at("observed_at"))


@register("tool_node_neighbors", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, GRAPH, NEIGHBORS, recursive=True)
          + f"""SELECT DISTINCT s.patient_id, s.edge_id, s.relation, s.direction, s.neighbor_id, coalesce(n.label, s.neighbor_id) AS neighbor_label, n.kind AS neighbor_kind, s.confidence, ee.event_id AS evidence_event_id
 FROM seen s LEFT JOIN nodes n ON n.patient_id = s.patient_id AND n.node_id = s.neighbor_id LEFT JOIN ee ON ee.patient_id = s.patient_id AND ee.edge_id = s.edge_id
 WHERE s.node_id = '{NODE}' AND (s.relation <> 'mentioned_in' OR n.kind = 'source')""")
def tool_node_neighbors(spark, sf):
    """Node inspection with the events that each edge rests on."""
    return call(spark, sf, f"SELECT * FROM get_node_neighbors('{NODE}')")


@register("tool_explain_relationships", o.with_(o.GROUND, o.FACTS, FACT_TRENDS, o.entities_cte(), o.REL, recursive=True) + """SELECT DISTINCT r.patient_id, r.relation, r.from_key, r.to_key, r.confidence, m.event_id AS evidence_event_id
 FROM rels r JOIN ent a ON a.patient_id = r.patient_id AND a.entity_key = r.from_key JOIN ent b ON b.patient_id = r.patient_id AND b.entity_key = r.to_key
 JOIN mem m ON m.patient_id = r.patient_id AND m.entity_key IN (r.from_key, r.to_key)
 WHERE contains(lower(concat(a.canonical_label, ' ', b.canonical_label)), 'kidney') OR contains(lower(concat(a.canonical_label, ' ', b.canonical_label)), 'advil')""")
def tool_explain_relationships(spark, sf):
    """Explained relationships with the events of both ends."""
    return call(spark, sf, "SELECT patient_id, relation, from_key, to_key, confidence, evidence_event_id FROM explain_relationships('kidney, Advil', 1000)")
