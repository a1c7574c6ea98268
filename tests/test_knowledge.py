import datetime as dt

from pyspark.sql import functions as F

from carelattice.functions.values import confidence, review_status
from carelattice.lexicon import Lexicon
from carelattice.operators import contradictions, entities, facts, graph, relationships, reports, risk, trends


def derive(events, sources=None, own=False):
    f = facts.clinical_facts(events, sources).persist()
    e, m = entities.resolve(f, block_by_event_kind=own)
    return f, e.persist(), m.persist()


def labels(df, col="canonical_label"):
    return sorted(r[col] for r in df.collect())


# -- confidence ------------------------------------------------------------------------------

def score(spark, source="emr", ai=False, ai_score=None, grounded=True, quote=True, coding=True, uncertain=False, n=1):
    return spark.range(1).select(confidence(
        F.lit(source), F.lit(ai), F.lit(ai_score).cast("double"), F.lit(grounded), F.lit(quote), F.lit(coding),
        F.lit(uncertain), F.lit(n)).alias("s")).first()["s"]


def test_structured_facts_score_high(spark):
    assert score(spark) >= 0.95


def test_extractor_judgement_is_preserved(spark):
    high = score(spark, "voice", True, 0.92)
    low = score(spark, "voice", True, 0.55, False, False, False, True)
    assert high > low and high >= 0.75 and low < 0.45


def test_corroboration_raises_score(spark):
    one = score(spark, "voice", quote=False, coding=False)
    two = score(spark, "voice", quote=False, coding=False, n=2)
    three = score(spark, "voice", grounded=False, quote=False, coding=False, n=3)
    assert two > one and three == 0.95


def test_review_status(spark):
    r = spark.range(1).select(review_status(F.lit(0.74), F.lit(False)).alias("a"), review_status(F.lit(0.9), F.lit(True)).alias("b"),
                              review_status(F.lit(0.75), F.lit(False)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("needs_review", "needs_review", "accepted")


def test_emr_beats_voice_and_metadata_is_kept(spark, make_events):
    e = make_events(dict(kind="condition", label="Type 2 diabetes", source_type="emr"),
                    dict(kind="condition", label="Type 2 diabetes", source_type="voice"))
    a, b = facts.candidate_facts(e).orderBy("seq").collect()
    assert a.confidence > b.confidence
    ai = make_events(dict(kind="medication", label="Metformin")).withColumn("ai_extracted", F.lit(True)).withColumn("ai_score", F.lit(0.88))
    c = facts.candidate_facts(ai).first()
    assert c.known and c.ai_score == 0.88 and c.confidence > 0.78


def test_corroboration_updates_status(spark, make_events, make_sources):
    e = make_events(dict(kind="symptom", label="Fatigue", source="a"), dict(kind="symptom", label="Fatigue", source="b"))
    s = make_sources(("p1", "a", "voice", None), ("p1", "b", "doctor_note", None))
    f = facts.validate(facts.candidate_facts(e, s)).withColumn("confidence", F.lit(0.72)).withColumn("review_status", F.lit("needs_review"))
    out = facts.corroborate(f).collect()
    assert all(r.confidence >= 0.75 and r.review_status == "accepted" for r in out)


# -- facts -------------------------------------------------------------------------------------

def test_validation_cascade(spark, make_events):
    e = make_events(dict(kind="condition", label=" "), dict(kind="condition", label="CKD"),
                    dict(kind="condition", label="Rash"), dict(kind="condition", label="Gout"))
    e = e.withColumns({"negated": F.col("seq") == 1, "uncertain": F.col("seq") >= 2,
                       "ai_extracted": F.col("seq") == 2, "ai_score": F.when(F.col("seq") == 2, 0.1),
                       "observed_at": F.when(F.col("seq") < 3, F.col("observed_at"))})
    v = {r.seq: r for r in facts.validate(facts.candidate_facts(e)).collect()}
    assert [v[i].review_reason for i in range(4)] == ["Empty label", "Negated fact", "Low extraction confidence", "Invalid observed date"]
    assert not any(r.accepted for r in v.values())
    assert facts.review_items(facts.validate(facts.candidate_facts(e))).count() == 4


def test_first_of_equal_facts_wins(spark, make_events):
    rows = [dict(kind="lab", label="a1c", value="6.8", id=f"e{i}") for i in range(50)]
    f = facts.clinical_facts(make_events(*rows, dict(kind="lab", label="HbA1c", value="6.8", source="src_b"))).collect()
    assert sorted(r.fact_id for r in f) == ["e0", "e50"] and {r.source_count for r in f} == {2}


def test_provenance_and_chunk(spark, make_events, make_sources):
    chunks = spark.createDataFrame([("p1", "src_a", 0, "c0", 0, 9), ("p1", "src_a", 1, "c1", 9, 20)],
                                   "patient_id string, source_id string, ordinal int, chunk_id string, start_offset int, end_offset int")
    e = make_events(dict(kind="condition", label="CKD", status="resolved"))
    f = facts.clinical_facts(e, make_sources(("p1", "src_a", "emr", "x" * 300)), chunks=chunks).first()
    assert f.provenance.chunk_id == "c0" and f.provenance.method == "rules" and len(f.provenance.quote) == 240
    assert f.valid_to == f.observed_at and f.source_title == "Source src_a"


def test_notes_stay_out_of_entities(spark, make_events):
    f, e, _ = derive(make_events(dict(kind="note", label="Patient-reported context", value="parking and portal frustration")))
    assert [r.relevance for r in f.collect()] == ["evidence_only"] and e.count() == 0


# -- entities ----------------------------------------------------------------------------------

def test_aliases_become_one_entity_with_two_sources(spark, make_events, make_sources):
    ev = make_events(dict(kind="condition", label="CKD", source="src_a"), dict(kind="condition", label="Chronic kidney disease", source="src_b"))
    _, e, m = derive(ev)
    assert labels(e) == ["Chronic kidney disease"]
    assert sorted(r.alias for r in entities.entity_aliases(m).collect()) == ["CKD", "Chronic kidney disease"]
    src = make_sources(("p1", "src_a", "voice", "x"), ("p1", "src_b", "voice", "y"))
    g = graph.build(spark.createDataFrame([("p1", "Pat")], "patient_id string, name string"), src, e, m,
                    relationships.relationships(e))
    mention = [r.edge_id for r in g.edges.filter("relation = 'mentioned_in'").collect()]
    assert len(mention) == 2
    assert {r.event_id for r in g.edge_evidence.filter(F.col("edge_id").isin(mention)).collect()} == {"e0", "e1"}


def test_brand_and_dose_ground_to_ibuprofen(spark, make_events):
    _, e, _ = derive(make_events(dict(kind="medication", label="Advil"), dict(kind="medication", label="ibuprofen 400mg")))
    r = e.collect()
    assert len(r) == 1 and r[0].canonical_label == "Ibuprofen" and "nsaid" in r[0].drug_classes and r[0].coding_system == "RxNorm"


def test_near_duplicate_unknown_labels_merge_per_patient(spark, make_events):
    ev = make_events(dict(kind="condition", label="Fibromyalgia syndrome", patient="a"),
                     dict(kind="condition", label="Fibromyalgia syndromes", patient="a"),
                     dict(kind="condition", label="Fibromyalgia syndromes", patient="b"),
                     dict(kind="condition", label="Type 1 diabetes", patient="a"), dict(kind="condition", label="Type 2 diabetes", patient="a"))
    _, e, _ = derive(ev)
    by = {p: sorted(r.canonical_label for r in e.collect() if r.patient_id == p) for p in "ab"}
    assert by["a"] == ["Fibromyalgia Syndromes", "Type 1 diabetes", "Type 2 diabetes"]
    assert by["b"] == ["Fibromyalgia Syndromes"]


def test_patients_do_not_influence_each_other(spark, make_events):
    rows = [dict(kind="condition", label="CKD", status="active"), dict(kind="medication", label="Advil"),
            dict(kind="lab", label="eGFR", value="72", at=dt.datetime(2026, 1, 1)), dict(kind="lab", label="eGFR", value="48", at=dt.datetime(2026, 3, 1))]
    alone = risk.risk_alerts(make_events(*rows)).select("title").collect()
    both = make_events(*[dict(r, patient=p, id=f"{p}{i}") for p in ("p1", "p2") for i, r in enumerate(rows)])
    for p in ("p1", "p2"):
        assert sorted(risk.risk_alerts(both).filter(F.col("patient_id") == p).select("title").collect()) == sorted(alone)


# -- relationships -----------------------------------------------------------------------------

def rels(events):
    f, e, m = derive(events)
    return relationships.relationships(e, trends.trend_summary(f, grounded=True))


def test_interaction_edge(spark, make_events):
    r = rels(make_events(dict(kind="medication", label="Warfarin"), dict(kind="medication", label="Aspirin"))).collect()
    assert [x.relation for x in r] == ["contraindicated_with"] and r[0].from_key == "medication:warfarin"


def test_worsening_edge(spark, make_events):
    r = rels(make_events(dict(kind="condition", label="Type 2 diabetes"), dict(kind="lab", label="HbA1c", value="6.8"),
                         dict(kind="lab", label="HbA1c", value="8.4", at=dt.datetime(2026, 4, 1)))).collect()
    assert [x.relation for x in r] == ["worsening_trend"]
    assert r[0].rationale == "HbA1c is trending rising (6.8→8.4 %), consistent with worsening Type 2 diabetes."


def test_barrier_keeps_its_kind_on_request(spark, make_events):
    ev = make_events(dict(kind="medication", label="Lisinopril"), dict(kind="barrier", label="Lisinopril refill issue"))
    _, e, _ = derive(ev)
    assert labels(e) == ["Lisinopril"]
    _, own, _ = derive(ev, own=True)
    r = relationships.barrier_relationships(own).collect()
    assert [(x.from_key, x.to_key) for x in r] == [("barrier:lisinopril", "medication:lisinopril")]


def test_relation_schema(spark):
    rows = [("medication", "reported", "symptom"), ("patient", "reported", "symptom"), ("medication", "contraindicated_with", "condition"),
            ("barrier", "possibly_related_to", "source")]
    df = spark.createDataFrame(rows, "from_kind string, relation string, to_kind string")
    assert relationships.valid_relations(df).count() == 3
    assert relationships.is_symmetric(df).filter("symmetric").count() == 2


def test_evidence_path_leaves_unrelated_nodes_out(spark, make_events, make_sources):
    ev = make_events(dict(kind="condition", label="CKD"), dict(kind="medication", label="Ibuprofen"),
                     dict(kind="lab", label="Potassium", value="5.4"), dict(kind="condition", label="Asthma"))
    f, e, m = derive(ev)
    g = graph.build(spark.createDataFrame([("p1", "Pat")], "patient_id string, name string"), make_sources(("p1", "src_a", "voice", "t")),
                    e, m, relationships.relationships(e))
    focus = spark.createDataFrame([("p1", "q", "e0"), ("p1", "q", "e1")], "patient_id string, query_id string, event_id string")
    nodes, edges = graph.query_graph(g, alert_events=focus)
    names = {r.label for r in nodes.collect()}
    assert "Asthma" not in names and {"Chronic kidney disease", "Ibuprofen", "Pat"} <= names
    assert "contraindicated_with" in {r.relation for r in edges.collect()}
    assert graph.focus_events(g, alert_events=focus).count() == 2


# -- risk, contradictions, reports -------------------------------------------------------------

def titles(df):
    return [r.title for r in df.orderBy("severity_rank", "family", "k1", "k2", "rule_no").collect()]


def test_unseen_interaction_alert(spark, make_events):
    a = risk.risk_alerts(make_events(dict(kind="medication", label="Spironolactone"), dict(kind="medication", label="Lisinopril")))
    assert "Spironolactone + Lisinopril interaction" in titles(a)


def test_interleaved_interactions_appear_both_ways(spark, make_events):
    ev = make_events(*[dict(kind="medication", label=x) for x in ("Warfarin", "Advil", "Warfarin")])
    a = risk.risk_alerts(ev).filter("family = 2").collect()
    assert {(r.title, r.event_a, r.event_b) for r in a} == {("Warfarin + Ibuprofen interaction", "e0", "e1"),
                                                            ("Ibuprofen + Warfarin interaction", "e1", "e2")}


def test_lab_range_alerts(spark, make_events):
    assert any("TSH" in t for t in titles(risk.risk_alerts(make_events(dict(kind="lab", label="TSH", value="9.2")))))
    assert titles(risk.risk_alerts(make_events(dict(kind="lab", label="TSH", value="2.0")))) == []


def test_blood_pressure_and_gap_and_barrier(spark, make_events):
    ev = make_events(dict(kind="vital", label="bp", value="165/95"), dict(kind="medication", label="Warfarin"),
                     dict(kind="barrier", label="No ride"), dict(kind="barrier", label="no ride"))
    a = risk.risk_alerts(ev)
    assert titles(a) == ["Elevated blood pressure", "Care barrier: No ride", "Monitoring gap for Warfarin"]
    ev_rows = risk.alert_evidence(a, ev).collect()
    assert {r.event_id for r in ev_rows} == {"e0", "e1", "e2"}


def test_status_contradiction(spark, make_events):
    f = facts.clinical_facts(make_events(dict(kind="condition", label="CKD", status="active", source="a"),
                                         dict(kind="condition", label="Chronic kidney disease", status="resolved", source="b"))).persist()
    c = contradictions.contradictions(f).collect()
    assert [r.tag for r in c] == ["active-vs-resolved"] and c[0].review_id.startswith("review_")
    assert contradictions.contradiction_members(f).count() == 2


def test_report_is_data_driven(spark, make_events):
    ev = make_events(dict(kind="condition", label="Asthma"), dict(kind="medication", label="Albuterol"))
    patients = spark.createDataFrame([("p1", "Jordan Lee")], "patient_id string, name string")
    b = reports.report_briefs(patients, ev, risk.risk_alerts(ev)).collect()
    one = next(r for r in b if r.specialty == "primary_care")
    assert len(b) == 5 and one.summary == "Jordan Lee has a history of Asthma. Current medications include Albuterol."
    assert one.questions[0] == "What should I prioritize for Asthma before the next visit?"


def test_report_lines_and_merge(spark, make_events, make_sources):
    ev = make_events(*[dict(kind="medication", label=f"Drug {i}", value="1 mg") for i in range(30)])
    patients = spark.createDataFrame([("p1", "J")], "patient_id string, name string")
    b = reports.report_briefs(patients, ev, risk.risk_alerts(ev)).filter("specialty = 'pharmacy'").persist()
    assert "Drug 0, Drug 1, Drug 2, Drug 3, and 26 more" in b.first().summary
    lines = reports.report_lines(b, reports.report_lists(ev, make_sources(("p1", "src_a", "voice", "t")))).collect()
    assert sum(r.text.startswith("- Drug") for r in lines) == 30 and any(r.text == "- Source src_a (voice)" for r in lines)
    x = spark.createDataFrame([("p1", "pharmacy", "Short.", [], ["Q?"])],
                              "patient_id string, specialty string, summary string, top_concerns array<string>, questions array<string>")
    m = reports.merge_extracted(b, x).first()
    assert m.summary == "Short." and list(m.questions) == ["Q?"]


def test_lexicon_tables_are_consistent(spark):
    lex = Lexicon.default()
    assert len(lex.concepts) == 64 and len(lex.contraindications) == 8 and len(lex.interactions) == 7
    assert len(lex.relation_types) == 13 and len(lex.risk_links) == 10 and len(lex.lab_links) == 8
