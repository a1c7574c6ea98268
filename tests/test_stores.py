import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelattice.operators import reports, search, tools
from carelattice.operators import graph as gr
from carelattice.sources import workspace

AT = dt.datetime(2026, 1, 1)


# -- workspace -----------------------------------------------------------------------------------

def sources(spark, *rows):
    return spark.createDataFrame([(u, i, t, f"Title {i}", AT, None, n) for n, (u, i, t) in enumerate(rows)],
                                 "user_id string, id string, type string, title string, captured_at timestamp, raw_text string, n long")


def facts(spark, *rows):
    return spark.createDataFrame([(u, i, i, s, label, c, "graph", "accepted", n) for n, (u, i, s, label, c) in enumerate(rows)],
                                 "user_id string, id string, event_id string, source_id string, label string, confidence double, relevance string, review_status string, n long")


def test_workspace_write_and_load(spark, tmp_path):
    name, root = "wtest", str(tmp_path)
    assert workspace.load(spark, name, "u1") == {}
    bad = workspace.write(name, root, "sources", sources(spark, ("u1", "s1", "emr"), ("u1", "s2", "fax"), ("u2", "s1", "voice")), "n")
    assert [(r.id, r.reason) for r in bad.collect()] == [("s2", "check")]
    rows = facts(spark, ("u1", "f1", "s1", "old", 0.5), ("u1", "f1", "s1", "new", 0.6), ("u1", "f2", "s2", "lost", 0.5), ("u2", "f3", "s1", "b", 0.5), ("u2", "f4", "s1", "c", 2.0), ("u3", "f5", "s1", "d", 0.5))
    bad = workspace.write(name, root, "clinical_facts", rows, "n")
    assert sorted((r.id, r.reason) for r in bad.collect()) == [("f2", "reference"), ("f4", "check"), ("f5", "reference")]
    workspace.write(name, root, "clinical_facts", facts(spark, ("u2", "f3", "s1", "again", 0.9)), "n")
    mine = workspace.load(spark, name, "u1")
    assert [(r.id, r.label) for r in mine["clinical_facts"].collect()] == [("f1", "new")]
    assert [(r.event_id, r.patient_id, r.fact_id) for r in mine["events"].collect()] == [("f1", "u1", "f1")]
    joined = workspace.facts_with_sources(spark, name)
    assert sorted((r.user_id, r.id, r.label, r.title, r.source_type) for r in joined.collect()) == [("u1", "f1", "new", "Title s1", "emr"), ("u2", "f3", "again", "Title s1", "voice")]
    with pytest.raises(ValueError):
        workspace.load(spark, name, "")


def test_joins_along_references_exchange_nothing(spark, tmp_path):
    name = "wplan"
    workspace.write(name, str(tmp_path), "sources", sources(spark, *((f"u{i}", f"s{i}", "emr") for i in range(50))), "n")
    workspace.write(name, str(tmp_path), "clinical_facts", facts(spark, *((f"u{i}", f"f{i}", f"s{i}", "x", 0.5) for i in range(50))), "n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = workspace.facts_with_sources(spark, name)
        assert joined.count() == 50 and "Exchange hashpartitioning(user_id" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- reports -------------------------------------------------------------------------------------

def test_reports_are_written_in_order(spark, tmp_path):
    rows = [(p, "cardiology", n % 8, n // 8, None, n, f"line {n % 8} {n // 8:04d}") for p in (1, 2) for n in range(4000)]
    lines = spark.createDataFrame(rows, "patient_id long, specialty string, section_no int, part int, observed_at timestamp, seq long, text string").repartition(7)
    reports.write_reports(lines, str(tmp_path / "r"))
    bodies = reports.read_reports(spark, str(tmp_path / "r")).collect()
    want = "\n".join(f"line {s} {k:04d}" for s in range(8) for k in range(500))
    assert sorted(b.patient_id for b in bodies) == [1, 2] and all(b.body == want for b in bodies)


# -- tools ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def installed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tools"))
    day = lambda n: AT + dt.timedelta(days=n)
    events = spark.createDataFrame(
        [("p1", f"e{n}", n, "s", "emr", "lab", "eGFR", str(60 - 5 * n), "mL/min", day(n), None) for n in range(4)]
        + [("p1", "e9", 9, "s", "emr", "lab", "eGFR", "n/a", None, day(1), None), ("p2", "x1", 1, "s", "emr", "lab", "eGFR", "50", "mL/min", day(0), None),
           ("p1", "m1", 10, "s", "emr", "medication", "Advil", None, None, day(2), "active")],
        "patient_id string, event_id string, seq long, source_id string, source_type string, kind string, label string, value string, unit string, observed_at timestamp, status string")
    alerts = spark.createDataFrame([("p1", "a", "A", "high", 0, "why"), ("p1", "b", "B", "low", 2, "why")],
                                   "patient_id string, alert_key string, title string, severity string, severity_rank int, explanation string")
    evidence = spark.createDataFrame([("p1", "a", "e1"), ("p1", "a", "e2"), ("p1", "a", "e1")], "patient_id string, alert_key string, event_id string")
    nodes = spark.createDataFrame([("p1", "lab:egfr", "lab", "eGFR: 45", "45", "mL/min"), ("p1", "medication:advil", "medication", "Ibuprofen", None, None), ("p1", "node_src_s", "source", "S lab", None, None)],
                                  "patient_id string, node_id string, kind string, label string, latest_value string, unit string")
    edges = spark.createDataFrame([("p1", "lab:egfr", "medication:advil", "possibly_related_to", 0.7), ("p1", "medication:advil", "node_src_s", "mentioned_in", 1.0)],
                                  "patient_id string, from_node string, to_node string, relation string, confidence double")
    edges = edges.withColumn("edge_id", gr.edge_id())
    graph = gr.Graph(nodes, spark.createDataFrame([("p1", "lab:egfr", "e1", 1), ("p1", "medication:advil", "m1", 10)], "patient_id string, node_id string, event_id string, seq long"), edges,
                     edges.select("patient_id", "edge_id", F.explode(F.array(F.lit("e1"), F.lit("m1"))).alias("event_id")))
    aliases = spark.createDataFrame([("p1", "medication:advil", "Advil")], "patient_id string, entity_key string, alias string")
    rels = spark.createDataFrame([("p1", "lab:egfr", "medication:advil", "possibly_related_to", 0.7, "low", "r", 1, 0, 0, 0, "eGFR", "Ibuprofen")],
                                 "patient_id string, from_key string, to_key string, relation string, confidence double, severity string, rationale string, family int, from_seq long, rule_no int, to_seq long, from_label string, to_label string")
    members = spark.createDataFrame([("p1", "lab:egfr", "e1", "e1", 1), ("p1", "medication:advil", "m1", "m1", 10)], "patient_id string, entity_key string, fact_id string, event_id string, seq long")
    tools.store(root, events, alerts, evidence, graph, aliases, rels, members)
    tools.install(spark, root)
    return spark


@pytest.mark.parametrize("sql, want", [
    ("SELECT patient_id, metric, readings FROM list_metrics() ORDER BY 1", [("p1", "eGFR", 4), ("p2", "eGFR", 1)]),
    ("SELECT event_id, value FROM get_metric_series('eGFR', since_days => 1, as_of => TIMESTAMP '2026-01-04 00:00:00') ORDER BY 1", [("e2", 50.0), ("e3", 45.0)]),
    ("SELECT patient_id, points, first_value, last_value, pct_change, slope_per_day, direction, reason FROM compute_trend('eGFR') ORDER BY 1",
     [("p1", 4, 60.0, 45.0, -25.0, -5.0, "decreasing", None), ("p2", 1, None, None, None, None, "stable", "insufficient data")]),
    ("SELECT event_id FROM query_events(label_pattern => 'ADV')", [("m1",)]),
    ("SELECT event_id FROM query_events('lab', 'gfr', 0) WHERE patient_id = 'p2'", [("x1",)]),
    ("SELECT title, severity, evidence_event_id FROM get_risk_alerts('high') ORDER BY 3", [("A", "high", "e1"), ("A", "high", "e2")]),
    ("SELECT title, evidence_event_id FROM get_risk_alerts() WHERE severity = 'low'", [("B", None)]),
    ("SELECT node_id, score, rank FROM search_graph('advil or a lab') ORDER BY 1", [("lab:egfr", 1, 1), ("medication:advil", 1, 2)]),
    ("SELECT count(*) FROM search_graph('a')", [(2,)]),
    ("SELECT event_id, value FROM get_node_events('lab:egfr')", [("e1", "55")]),
    ("SELECT relation, direction, neighbor_kind, evidence_event_id FROM get_node_neighbors('medication:advil') ORDER BY 1, 4",
     [("mentioned_in", "outgoing", "source", "e1"), ("mentioned_in", "outgoing", "source", "m1"), ("possibly_related_to", "incoming", "lab", "e1"), ("possibly_related_to", "incoming", "lab", "m1")]),
    ("SELECT phrase, evidence_event_id FROM explain_relationships('ibuprofen') ORDER BY 2", [("eGFR is possibly related to Ibuprofen", "e1"), ("eGFR is possibly related to Ibuprofen", "m1")]),
    ("SELECT count(*) FROM explain_relationships('kidney')", [(0,)])])
def test_tools_in_sql(installed, sql, want):
    assert [tuple(r) for r in installed.sql(sql).collect()] == want


# -- hybrid search over facts and chunks -----------------------------------------------------------

def test_vector_hits_are_routed_by_what_they_refer_to(spark):
    docs = spark.createDataFrame([("p1", "doc_evt_e1", "s1", "e1"), ("p1", "doc_src_s1", "s1", None), ("p2", "doc_evt_e1", "s1", "e1")], "patient_id string, doc_id string, source_id string, event_id string")
    vectors = spark.createDataFrame([("p1", "fact:p1:e1", "fact", "e1", "s1", [1.0, 0.0]), ("p1", "chunk:p1:c0", "chunk", "c0", "s1", [0.8, 0.0]), ("p1", "chunk:p1:c1", "chunk", "c1", "s1", [0.1, 0.0]),
                                     ("p1", "fact:p1:gone", "fact", "gone", "s1", [2.0, 0.0]), ("p2", "fact:p2:e1", "fact", "e1", "s1", None)],
                                    "patient_id string, id string, ref_type string, ref_id string, source_id string, vector array<double>")
    asked = spark.createDataFrame([("p1", 1, [1.0, 1.0]), ("p2", 1, [1.0, 1.0]), ("p3", 1, None)], "patient_id string, query_id int, vector array<double>")
    hits = search.scoped_vector_top_k(vectors, asked, ["patient_id"], 3)
    assert sorted((r.id, r["rank"]) for r in hits.collect()) == [("chunk:p1:c0", 3), ("fact:p1:e1", 2), ("fact:p1:gone", 1)]
    found = search.semantic_documents(hits, docs)
    assert sorted((r.doc_id, r["rank"]) for r in found.collect()) == [("doc_evt_e1", 1), ("doc_src_s1", 2)]
    assert search.clamp_k(None) == 12 and search.clamp_k(0) == 1 and search.clamp_k(500) == 50
