"""Named data tools: SQL table functions over stored knowledge tables.

``store`` writes the tables once, sorted by patient, so a question about one patient reads that patient's row groups;
``install`` makes them temporary views and registers the functions, so that they can be called from ``spark.sql`` and
joined like tables.  Every function returns rows of all patients with patient_id first; a condition on it is pushed into the
scan.  Evidence is one row per event.  ``as_of`` takes the place of the current date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.operators import graph as gr
from carelattice.operators import relationships as rel
from carelattice.operators import risk, search, trends

VIEW = "care_"

_SINCE = "(since_days IS NULL OR since_days <= 0 OR observed_at >= timestampadd(DAY, -since_days, as_of))"
_TOKENS = "filter(split(lower({}), '[^a-z0-9]+'), t -> length(t) > 2)"
_ROUND = "floor(({}) * 100 + 0.5) / 100"

# name: (arguments, result columns, body)
FUNCTIONS = {
    "list_metrics": ("", "patient_id {id}, metric STRING, readings BIGINT, unit STRING, first_observed TIMESTAMP, last_observed TIMESTAMP",
                     "SELECT patient_id, metric, readings, unit, first_observed, last_observed FROM care_metrics"),
    "get_metric_series": ("name STRING, since_days INT DEFAULT NULL, as_of TIMESTAMP DEFAULT NULL",
                          "patient_id {id}, event_id STRING, observed_at TIMESTAMP, value DOUBLE, unit STRING",
                          f"SELECT patient_id, event_id, observed_at, value, unit FROM care_points WHERE metric = name AND {_SINCE}"),
    "compute_trend": ("name STRING, since_days INT DEFAULT NULL, as_of TIMESTAMP DEFAULT NULL",
                      "patient_id {id}, metric STRING, points BIGINT, first_value DOUBLE, last_value DOUBLE, unit STRING, pct_change DOUBLE, slope_per_day DOUBLE, "
                      "direction STRING, reason STRING, window_start TIMESTAMP, window_end TIMESTAMP",
                      f"""SELECT patient_id, metric, points, if(points > 1, a, NULL), if(points > 1, z, NULL), if(points > 1, u, NULL), if(points > 1, {_ROUND.format('pct')}, NULL),
 if(points > 1, {_ROUND.format('slope')}, NULL), CASE WHEN points < 2 OR abs(pct) < 5 THEN 'stable' WHEN z > a THEN 'increasing' ELSE 'decreasing' END,
 if(points < 2, 'insufficient data', NULL), if(points > 1, s, NULL), if(points > 1, e, NULL)
 FROM (SELECT *, CASE WHEN a <> 0 THEN (z - a) / abs(a) * 100 ELSE 0D END AS pct FROM (
  SELECT patient_id, metric, count(*) AS points, min_by(value, struct(observed_at, seq)) AS a, max_by(value, struct(observed_at, seq)) AS z, min_by(unit, struct(observed_at, seq)) AS u,
   coalesce(regr_slope(value, unix_micros(observed_at) / 86400000000D), 0D) AS slope, min(observed_at) AS s, max(observed_at) AS e
  FROM care_points WHERE metric = name AND {_SINCE} GROUP BY patient_id, metric))"""),
    "query_events": ("type STRING DEFAULT NULL, label_pattern STRING DEFAULT NULL, since_days INT DEFAULT NULL, as_of TIMESTAMP DEFAULT NULL",
                     "patient_id {id}, event_id STRING, kind STRING, label STRING, value STRING, unit STRING, observed_at TIMESTAMP, status STRING",
                     f"""SELECT patient_id, event_id, kind, label, value, unit, observed_at, status FROM care_events
 WHERE (type IS NULL OR kind = type) AND (label_pattern IS NULL OR label RLIKE concat('(?i)', label_pattern)) AND {_SINCE}"""),
    "get_risk_alerts": ("least_severity STRING DEFAULT 'low'", "patient_id {id}, alert_key STRING, title STRING, severity STRING, explanation STRING, evidence_event_id STRING",
                        """SELECT a.patient_id, a.alert_key, a.title, a.severity, a.explanation, e.event_id FROM care_alerts a LEFT JOIN care_alert_events e
 ON e.patient_id = a.patient_id AND e.alert_key = a.alert_key WHERE a.severity_rank <= CASE least_severity WHEN 'high' THEN {high} WHEN 'medium' THEN {medium} ELSE {low} END"""),
    "search_graph": ("query STRING, most INT DEFAULT 8", "patient_id {id}, node_id STRING, kind STRING, label STRING, latest_value STRING, unit STRING, score INT, rank INT",
                     f"""SELECT n.patient_id, n.node_id, n.kind, n.label, n.latest_value, n.unit, n.score, n.rank FROM (
 SELECT n.*, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY n.patient_id ORDER BY coalesce(s.score, 0) DESC, n.node_id) AS rank FROM care_nodes n LEFT JOIN (
  SELECT patient_id, node_id, cast(count(DISTINCT token) AS INT) AS score FROM (
   SELECT patient_id, node_id, explode(filter({_TOKENS.format('query')}, t -> contains(text, t))) AS token FROM care_haystacks) GROUP BY patient_id, node_id) s
 ON s.patient_id = n.patient_id AND s.node_id = n.node_id
 WHERE n.kind <> 'source' AND (size({_TOKENS.format('query')}) = 0 OR s.score > 0)) n WHERE n.rank <= most"""),
    "get_node_events": ("node STRING", "patient_id {id}, event_id STRING, kind STRING, label STRING, value STRING, unit STRING, observed_at TIMESTAMP, status STRING",
                        """SELECT e.patient_id, e.event_id, e.kind, e.label, e.value, e.unit, e.observed_at, e.status FROM care_node_events n JOIN care_events e
 ON e.patient_id = n.patient_id AND e.event_id = n.event_id WHERE n.node_id = node"""),
    "get_node_neighbors": ("node STRING", "patient_id {id}, edge_id STRING, relation STRING, direction STRING, neighbor_id STRING, neighbor_label STRING, neighbor_kind STRING, confidence DOUBLE, evidence_event_id STRING",
                           """SELECT n.patient_id, n.edge_id, n.relation, n.direction, n.neighbor_id, n.neighbor_label, n.neighbor_kind, n.confidence, e.event_id FROM care_neighbors n
 LEFT JOIN care_edge_events e ON e.patient_id = n.patient_id AND e.edge_id = n.edge_id WHERE n.node_id = node"""),
    "explain_relationships": ("query STRING DEFAULT '', most INT DEFAULT 12",
                              "patient_id {id}, rank INT, from_key STRING, relation STRING, phrase STRING, to_key STRING, severity STRING, rationale STRING, confidence DOUBLE, evidence_event_id STRING",
                              f"""SELECT r.patient_id, r.rank, r.from_key, r.relation, r.phrase, r.to_key, r.severity, r.rationale, r.confidence, e.event_id FROM (
 SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY place) AS rank FROM care_relationships
 WHERE size({_TOKENS.format('query')}) = 0 OR exists({_TOKENS.format('query')}, t -> contains(labels, t))) r
 LEFT JOIN care_relationship_events e ON e.patient_id = r.patient_id AND e.from_key = r.from_key AND e.to_key = r.to_key AND e.relation = r.relation WHERE r.rank <= most"""),
}
TABLES = ("events", "points", "metrics", "alerts", "alert_events", "nodes", "haystacks", "node_events", "neighbors", "edge_events", "relationships", "relationship_events")


def write_by_patient(rows: DataFrame, path: str) -> None:
    """A patient's rows in one sorted file.  Split by hash: finding ranges would make every table twice."""
    rows.repartition("patient_id").sortWithinPartitions("patient_id").write.parquet(path)


def store(root: str, events: DataFrame, alerts: DataFrame, alert_evidence: DataFrame, graph: gr.Graph, aliases: DataFrame, relationships: DataFrame,
          members: DataFrame) -> None:
    """Write the tables that the tools read."""
    def write(name: str, rows: DataFrame) -> None:
        write_by_patient(rows, f"{root}/{name}")

    write("events", events.select("patient_id", "event_id", "kind", "label", "value", "unit", "observed_at", "status", "source_id"))
    write("points", trends.metric_series(events))
    write("metrics", trends.metric_catalog(events))
    write("alerts", alerts.select("patient_id", "alert_key", "title", "severity", "severity_rank", "explanation"))
    write("alert_events", alert_evidence.select("patient_id", "alert_key", "event_id").distinct())
    write("nodes", graph.nodes.select("patient_id", "node_id", "kind", "label", "latest_value", "unit"))
    write("haystacks", gr.haystacks(graph, aliases).withColumn("text", F.lower("text")))
    write("node_events", graph.node_events.select("patient_id", "node_id", "event_id").distinct())
    write("neighbors", gr.neighbors(graph))
    write("edge_events", graph.edge_evidence.select("patient_id", "edge_id", "event_id").distinct())
    place = F.struct((~F.col("relation").isin(*gr.REASONING_RELATIONS)).alias("other"), (-F.col("confidence")).alias("least"), "family", "from_seq", "rule_no", "to_seq", "from_key", "to_key")
    write("relationships", relationships.select(
        "patient_id", "from_key", "to_key", "relation", "confidence", "severity", "rationale", place.alias("place"),
        F.lower(F.concat_ws(" ", "from_label", "to_label")).alias("labels"),
        F.concat_ws(" ", F.col("from_label"), gr.relation_phrase(F.col("relation")), F.col("to_label")).alias("phrase")))
    write("relationship_events", rel.relationship_evidence(relationships, members).select("patient_id", "from_key", "to_key", "relation", "event_id").distinct())


def install(spark: SparkSession, root: str) -> list[str]:
    """Views and functions over the tables at ``root``; the names of the functions."""
    for name in TABLES:
        spark.read.parquet(f"{root}/{name}").createOrReplaceTempView(VIEW + name)
    kind = spark.table(f"{VIEW}events").schema["patient_id"].dataType.simpleString()
    ranks = {s: spark.range(1).select(risk.severity_rank(F.lit(s)).alias("r")).first().r for s in ("high", "medium", "low")}
    for name, (arguments, columns, body) in FUNCTIONS.items():
        for severity, rank in ranks.items():
            body = body.replace("{" + severity + "}", str(rank))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns.replace('{id}', kind)}) RETURN {body}")
    return list(FUNCTIONS)


def search_evidence(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Per patient and query the best documents with event, source and snippet; a full-text search is no relational
    function of its text, so this tool takes a table of questions."""
    return search.evidence_snippets(docs, queries, ["patient_id"])
