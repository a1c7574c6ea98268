import datetime as dt
import json

from pyspark.sql import functions as F

from carelattice.functions import text as tx
from carelattice.functions.display import age_years
from carelattice.operators import facts, proposals
from carelattice.sources import chunks, conversations, emr, extracted, notes, tables
from carelattice.streaming import incremental

RUN = dt.datetime(2026, 5, 1)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_functions(spark):
    r = one(spark, tx.title_case(F.lit("  a-fib  of THE heart ")).alias("t"), tx.stable_id("x", F.lit("ab")).alias("s"),
            tx.js_round(F.lit(-2.5), 0).alias("r"), tx.js_number(F.lit(72.0)).alias("n"), tx.js_number(F.lit(12345678.25)).alias("m"),
            tx.strip_code_fence(F.lit("```json\n{\"a\":1}\n```")).alias("f"),
            tx.distinct_strings(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b"))).alias("d"),
            tx.describe_list(F.array(*map(F.lit, "abcd")), F.lit(6)).alias("l"),
            age_years(F.lit("1990-06-15").cast("date"), F.lit("2026-06-14").cast("date")).alias("age"))
    assert r.t == "A-Fib Of The Heart" and r.s == "x_" + "2e9" and r.r == -2.0 and (r.n, r.m) == ("72", "12345678.25")
    assert r.f == '{"a":1}' and list(r.d) == ["A", "b"] and r.l == "a, b, c, d, and 2 more" and r.age == 35


def test_emr_scan_flatten_and_rejects(spark, tmp_path):
    folder = tmp_path / "pat7"
    folder.mkdir()
    (folder / "ok.json").write_text(json.dumps({
        "conditions": [{"label": "CKD", "onset": "2025-01-02"}, {"label": "Gout", "status": "resolved"}],
        "medications": [{"label": "Metformin", "dose": "500 mg", "start": "not a date"}],
        "labs": [{"label": "HbA1c", "value": 7, "unit": "%", "date": "2026-01-01"}], "vitals": [{"label": "bp", "value": "132/84"}],
        "encounters": [{"label": "Visit", "clinician": "Dr. A", "specialty": "cardiology"}], "careTasks": [{"label": "Recheck"}]}))
    (folder / "bad.json").write_text("{nope")
    (folder / "empty.json").write_text("{}")
    records, rejects = emr.read_emr(spark, str(folder))
    assert {r.reason for r in rejects.collect()} == {"Invalid JSON file", "No health records found"}
    ev = emr.flatten_emr(records, F.lit(RUN)).persist()
    rows = {r.label: r for r in ev.collect()}
    assert len(rows) == 7 and {r.patient_id for r in rows.values()} == {"pat7"}
    assert rows["HbA1c"].value == "7" and rows["HbA1c"].value_is_num and rows["bp"].value == "132/84" and not rows["bp"].value_is_num
    assert rows["CKD"].status == "active" and rows["Gout"].observed_at == RUN and rows["Recheck"].status == "unknown"
    assert rows["Visit"].clinician == "Dr. A" and rows["Metformin"].observed_at is None
    v = {r.label: r for r in facts.validate(facts.candidate_facts(ev, emr.emr_sources(records, F.lit(RUN)))).collect()}
    assert v["Metformin"].review_reason == "Invalid observed date" and v["CKD"].accepted and v["CKD"].source_title == "EMR import — ok.json"


def test_note_round_trip_and_gates(spark):
    df = spark.createDataFrame([("Clinician: Dr. B (cardiology)\nNote: Take Ibuprofen\nFollow-up: In May\nLabs: BMP",), ("plain words",)], "text string")
    a, b = notes.split_note(df).collect()
    assert (a.clinician, a.specialty, a.note, a.follow_up, a.lab, a.medication_change) == ("Dr. B", "cardiology", "Take Ibuprofen", "In May", "BMP", None)
    assert (b.clinician, b.specialty, b.note) == ("Clinician", "Unknown", "plain words")
    assert notes.split_note(df).select(notes.note_text()).first()[0] == df.first().text
    ok, no = notes.gate_spoken(spark.createDataFrame([("  short ",), ("long enough text",)], "text string"))
    assert ok.count() == 1 and no.count() == 1


def test_chunks_prefer_paragraphs_then_sentences(spark):
    para = "x" * 700 + "\n\n" + "y" * 900
    sent = "a" * 800 + ". " + "b" * 600
    edge = "c" * 1200 + ". d"
    docs = spark.createDataFrame([("p", f"  {para} "), ("s", sent), ("e", edge), ("h", "z" * 2500), ("n", None), ("b", " ")], "source_id string, raw_text string")
    out = {}
    for r in chunks.chunk_documents(docs).orderBy("source_id", "ordinal").collect():
        out.setdefault(r.source_id, []).append((r.start_offset, r.end_offset, r.text))
    assert [x[:2] for x in out["p"]] == [(0, 700), (700, 1602)] and out["p"][1][2] == "y" * 900
    assert [x[:2] for x in out["s"]] == [(0, 801), (801, 1402)] and out["e"][0][:2] == (0, 1201)
    assert [x[:2] for x in out["h"]] == [(0, 1200), (1200, 2400), (2400, 2500)] and set(out) == set("pseh")


def test_phrase_split_over_turns_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(conversations, "TURN_BUCKET", 2)
    talk = {1: ["so much shortness", "of", "breath now"], 2: ["shortness of", "breath"], 3: ["shortness", "and of breath"], 4: ["x", "y", "shortness", "of breath"]}
    rows = [(c, t * 2, "user", s) for c, turns in talk.items() for t, s in enumerate(turns)]
    rows += [(c, 1, "assistant", "shortness of breath?") for c in talk] + [(9, 0, "assistant", "hello")]
    m = conversations.valid_messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    found = {r.conv_id for r in conversations.conversation_events(m).filter("label = 'Shortness of breath'").collect()}
    assert found == {1, 2, 4}
    ctx = {r.conv_id: r for r in conversations.conversation_context(m).collect()}
    assert set(ctx) == set(talk) and ctx[1].chief_concern == "Shortness of breath" and ctx[3].chief_concern == "shortness and of breath"
    assert ctx[4].message_count == 5 and list(ctx[2].topics) == ["symptom: Shortness of breath"]


def test_extracted_defaults(spark):
    raw = json.dumps({"facts": [{"kind": "lab", "label": "a1c", "value": 7.5, "confidence": 3}, {"kind": "lab", "label": "x", "relevance": "ignore"},
                                {"kind": "nope", "label": "y"}, {"kind": "symptom", "label": "tired", "negated": True}]})
    p = spark.createDataFrame([("p1", "s1", "voice", raw)], "patient_id string, source_id string, source_type string, raw string")
    c = extracted.extracted_candidates(p, F.lit(RUN)).orderBy("pos").collect()
    assert [(r.label, r.ai_score, r.relevance, r.status) for r in c] == [("a1c", 1.0, "evidence_only", "active"), ("x", 0.65, "ignore", "active"), ("tired", 0.65, "evidence_only", "active")]
    ev = extracted.accepted_events(extracted.extracted_candidates(p, F.lit(RUN))).collect()
    assert [(r.label, r.value) for r in ev] == [("HbA1c", "7.5")]
    e = spark.createDataFrame([("p1", "s1", json.dumps({"events": [{"type": "note", "label": "n", "status": "odd"}, {"type": "x", "label": "z"}]}))],
                              "patient_id string, source_id string, raw string")
    assert [(r.kind, r.status) for r in extracted.parsed_events(e, F.lit(RUN)).collect()] == [("note", "active")]


def test_upsert_delete_and_references(spark, tmp_path):
    root, schema = str(tmp_path), "id string, user_id string, source_id string, text string, seq int"
    first = spark.createDataFrame([("c1", "u1", "s1", "old", 1), ("c2", "u2", "s9", "keep", 1), ("c1", "u1", "s1", "new", 2)], schema)
    tables.upsert(root, "source_chunks", first, "seq")
    tables.upsert(root, "source_chunks", spark.createDataFrame([("c1", "u1", "s1", "newest", 3), ("c3", "u1", "s2", "more", 1)], schema), "seq")
    assert {(r.id, r.text) for r in tables.scan(spark, root, "source_chunks").collect()} == {("c1", "newest"), ("c2", "keep"), ("c3", "more")}
    assert {r.id for r in tables.scan(spark, root, "source_chunks", "u1").collect()} == {"c1", "c3"}
    src = spark.createDataFrame([("u1", "s1")], "user_id string, id string")
    assert [r.id for r in tables.with_existing_source(tables.scan(spark, root, "source_chunks"), src).collect()] == ["c1"]
    tables.delete_user(spark, root, "u1")
    assert {r.id for r in tables.scan(spark, root, "source_chunks").collect()} == {"c2"}
    ok, bad = tables.checked("sources", spark.createDataFrame([("emr",), ("fax",)], "type string"))
    assert ok.count() == 1 and bad.count() == 1


def test_shared_report_lookup(spark, tmp_path):
    rep = spark.createDataFrame([("p1", "pharmacy", "s")], "patient_id string, specialty string, summary string")
    token = tables.share_reports(rep, str(tmp_path), F.lit(RUN), "salt").first().token
    assert tables.shared_report(spark, str(tmp_path), token).first().summary == "s"
    assert tables.shared_report(spark, str(tmp_path), "shr_" + "0" * 32).count() == 0


def test_incremental_stream_is_idempotent(spark, make_events, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    derive = lambda df: {"facts": facts.clinical_facts(df).select("patient_id", "fact_id", "source_count")}
    rows = [dict(kind="condition", label="CKD", id=f"{p}{s}", source=s, patient=p) for p in ("p1", "p2") for s in ("a", "b")]
    make_events(*rows[:3]).write.parquet(inbox, mode="append")
    schema = make_events(*rows[:1]).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    run = lambda: incremental.run_incremental(incremental.event_stream(spark, inbox, schema), root, derive, str(tmp_path / "cp"), 4)
    run().awaitTermination()
    make_events(*rows[3:]).write.parquet(inbox, mode="append")
    run().awaitTermination()
    out = {(r.patient_id, r.fact_id): r.source_count for r in spark.read.parquet(f"{root}/facts").collect()}
    assert out == {("p1", "p1a"): 2, ("p1", "p1b"): 2, ("p2", "p2a"): 2, ("p2", "p2b"): 2}
    incremental.apply_batch(make_events(*rows[3:]), 1, root, derive, 4)
    assert spark.read.parquet(f"{root}/facts").count() == 4


def test_incremental_drops_what_is_no_longer_derived(spark, make_events, tmp_path):
    """A patient's only output row vanishes with a second batch, and the bucket with it; a neighbour in the bucket keeps its row."""
    root = str(tmp_path / "out")
    derive = lambda df: {"open": df.groupBy("patient_id").agg(F.max_by("status", "seq").alias("status")).filter("status = 'active'")}
    batch = lambda p, s, n: make_events(dict(kind="condition", label="CKD", id=f"{p}{n}", status=s), patient=p).withColumn("seq", F.lit(n))
    for buckets, others in ((64, []), (1, ["p2"])):
        out = f"{root}/{buckets}"
        incremental.apply_batch(batch("p1", "active", 0), 0, out, derive, buckets)
        incremental.apply_batch(batch("p2", "active", 0), 1, out, derive, buckets)
        incremental.apply_batch(batch("p1", "resolved", 1), 2, out, derive, buckets)
        assert [r.patient_id for r in spark.read.parquet(f"{out}/open").collect()] == ["p2"]
        incremental.apply_batch(batch("p1", "active", 2), 3, out, derive, buckets)
        assert sorted(r.patient_id for r in spark.read.parquet(f"{out}/open").collect()) == ["p1", "p2"]


def test_streaming_dedup_keeps_old_facts(spark, make_events, tmp_path):
    """A fact observed years before others is no late row: it arrives now."""
    path = str(tmp_path / "s")
    dates = [dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 2), dt.datetime(2020, 5, 1)]
    for i, when in enumerate(dates):
        make_events(dict(kind="lab", label="a1c", value=f"{i}.5", at=when)).coalesce(1).write.parquet(path, mode="append")
    schema = spark.read.parquet(path).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    d = incremental.streaming_dedup(incremental.event_stream(spark, path, schema, 1), "30 days")
    q = d.writeStream.format("memory").queryName("old").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("old").count() == 3


def test_streaming_dedup_and_trends(spark, make_events, tmp_path):
    path = str(tmp_path / "s")
    make_events(dict(kind="lab", label="a1c", value="6.8"), dict(kind="lab", label="HbA1c", value="6.8"),
                dict(kind="lab", label="a1c", value="8.4", at=dt.datetime(2026, 2, 1))).write.parquet(path)
    schema = spark.read.parquet(path).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    d = incremental.streaming_dedup(incremental.event_stream(spark, path, schema), "365 days")
    t = incremental.streaming_trends(incremental.event_stream(spark, path, schema))
    for df, name, mode in ((d, "dd", "append"), (t, "tt", "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True) \
            .option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert spark.table("dd").count() == 2
    r = spark.table("tt").first()
    assert (r.points, r.first_value, r.last_value, r.direction, r.worsening) == (3, 6.8, 8.4, "rising", True)


def test_proposed_edges_are_checked(spark, make_events):
    nodes = spark.createDataFrame([("p1", "condition:ckd", "condition", "Chronic kidney disease"), ("p1", "lab:egfr", "lab", "eGFR: 48"),
                                   ("p1", "medication:advil", "medication", "Ibuprofen")], "patient_id string, node_id string, kind string, label string")
    nodes = nodes.withColumn("ord", F.struct(F.lit(2).alias("family"), F.lit(0).alias("first_seq"), "node_id"))
    ne = spark.createDataFrame([("p1", "lab:egfr", "e1")], "patient_id string, node_id string, event_id string")
    prop = spark.createDataFrame([("p1", 0, "egfr", "kidney disease", "worsening_trend", "r"), ("p1", 1, "eGFR: 48", "Chronic kidney disease", "worsening_trend", "dup"),
                                  ("p1", 2, "Ibuprofen", "eGFR", "takes", "bad"), ("p1", 3, "ibuprofen", "chronic kidney disease", "contraindicated_with", "known"),
                                  ("p1", 4, "unknown thing", "eGFR", "possibly_related_to", "x")],
                                 "patient_id string, pos int, from_label string, to_label string, relation string, reason string")
    known = spark.createDataFrame([("p1", "medication:advil|condition:ckd|contraindicated_with")], "patient_id string, edge_id string")
    e = proposals.proposed_edges(prop, nodes, ne, known)
    r = e.collect()
    assert [(x.from_node, x.to_node, x.rationale, x.confidence) for x in r] == [("lab:egfr", "condition:ckd", "r", 0.7)]
    ev = make_events(dict(kind="lab", label="eGFR"))
    assert [x.event_id for x in proposals.proposed_edge_evidence(e, ne, ev).collect()] == ["e1"]


def test_extra_alerts_trends_citations(spark, make_events, make_sources):
    ev = make_events(dict(kind="lab", label="eGFR", value="48", unit="mL"), dict(kind="symptom", label="Ankle swelling"))
    prop = spark.createDataFrame([("p1", i, t, "odd", None, None, "x", lab, None) for i, (t, lab) in enumerate(
        [("Known", ["eGFR"]), ("New", ["swelling"]), ("No proof", ["zzz"]), ("Third", ["eGFR"])])],
        "patient_id string, pos int, title string, severity string, time_horizon string, specialty array<string>, explanation string, evidence_labels array<string>, questions array<string>")
    existing = spark.createDataFrame([("p1", "KNOWN")], "patient_id string, title string")
    alerts, proof = proposals.extra_alerts(prop, existing, ev)
    assert [(r.title, r.severity, r.time_horizon) for r in alerts.collect()] == [("New", "medium", "Next 2 weeks")]
    assert [r.event_id for r in proof.collect()] == ["e1"]
    t = spark.createDataFrame([("p1", "t1", "eGFR", None, None, "astrology", "r", ["e0", "gone"]), ("p1", "t2", "x", None, None, "pharmacy", " why ", ["gone"])],
                              "patient_id string, trend_id string, metric string, direction string, severity string, specialty string, reason string, evidence_event_ids array<string>")
    trends_, evid = proposals.checked_trends(t, ev)
    assert [(r.trend_id, r.direction, r.specialty) for r in trends_.collect()] == [("t1", "stable", None)]
    assert [r.source_type for r in proposals.trend_evidence(evid, ev, make_sources(("p1", "other", "emr", None))).collect()] == ["event"]
    # a conversation node whose id sorts first holds the event too: the entity comes before it in graph order
    nodes = spark.createDataFrame([("p1", "n1", "lab", "eGFR: 48", 2), ("p1", "a_ctx", "conversation", "Chat", 3)],
                                  "patient_id string, node_id string, kind string, label string, family int")
    nodes = nodes.withColumn("ord", F.struct("family", F.lit(0).alias("first_seq"), "node_id")).drop("family")
    ne = spark.createDataFrame([("p1", "n1", "e0"), ("p1", "a_ctx", "e0")], "patient_id string, node_id string, event_id string")
    cites = spark.createDataFrame([("p1", 1, 0, None, "e0", "n"), ("p1", 1, 1, "n1", None, None), ("p1", 1, 2, "zz", None, " "), ("p1", 1, 3, None, None, "why")],
                                  "patient_id string, answer_id int, pos int, node_id string, event_id string, note string")
    c = proposals.resolve_citations(cites, nodes, ne, ev).orderBy("pos").collect()
    assert [(r.label, r.kind, r.node_id) for r in c] == [("eGFR 48 mL · Jan 2026", "lab", "n1"), ("eGFR: 48", "lab", "n1"), ("Supporting record", None, None), ("why", None, None)]
    parts = proposals.split_answer(spark.createDataFrame([(1, "High [1][2] now")], "answer_id int, answer string")).orderBy("part").collect()
    assert [(r.type, r.value, r.citation) for r in parts] == [("text", "High ", None), ("cite", "[1]", 1), ("cite", "[2]", 2), ("text", " now", None)]
