"""Plans that must not grow with copies of the input: where work is done once, and what stays off the driver."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelattice.operators import facts, grounding, proposals, reports, search, similarity, tools
from carelattice.plans import activity, catalog, catalog_ingest
from carelattice.session import cut_large
from carelattice.sources import emr, files


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_signatures_are_made_for_stored_distinct_labels(spark):
    """Conditions on the signatures stay above the distinct: it has been written."""
    labels = spark.createDataFrame([(p, "condition", n, True, True) for p in range(5) for n in ("Fibromyalgia syndrome", "Fibromyalgia syndromes", "CKD")],
                                   "patient_id int, block string, label string, left boolean, right boolean")
    made = similarity.label_signatures(labels, 0.84)
    assert made.inputFiles() and made.count() == 3
    pairs = similarity.similar_pairs(labels, 0.84, ("patient_id", "block"))
    assert sorted(r.patient_id for r in pairs.collect()) == [0, 1, 2, 3, 4]


def test_stored_tables_are_not_sent_to_the_driver(spark):
    rows = cut_large(spark.range(1000).select("id", F.lit("a").alias("x")))
    joined = rows.join(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    assert joined.count() == 1000 and "BroadcastHashJoin" not in plan(joined)


def test_only_pieces_that_are_asked_for_leave_the_scan(spark):
    targets = spark.createDataFrame([("p1", "n1", "Chronic kidney disease", 1), ("p1", "n2", "CKD", 2), ("p2", "n3", "eGFR: 50", 1), ("p2", "n4", "", 2), ("p2", None, None, 3)],
                                    "patient_id string, target_id string, text string, ord int")
    asked = spark.createDataFrame([("p1", "kidney"), ("p1", "KIDNEY"), ("p1", "the ckd stage"), ("p2", "egfr"), ("p2", "kidney"), ("p2", ""), ("p2", None)], "patient_id string, label string")
    found = proposals.fuzzy_lookup(asked, targets, "ord")
    assert {(r.patient_id, r.label): r.target_id for r in found.collect()} == {
        ("p1", "kidney"): "n1", ("p1", "KIDNEY"): "n1", ("p1", "the ckd stage"): "n2", ("p2", "egfr"): "n3", ("p2", ""): "n4"}
    met = plan(found).split("Physical Plan")[-1]
    assert met.index("LeftSemi") and "BroadcastHashJoin [g" in met


def test_exports_are_read_once(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.json").write_text('{"labs": [{"label": "eGFR", "value": "5.5", "unit": "x", "date": "2026-01-01"}]}')
    (tmp_path / "p1" / "b.json").write_text('{"labs": [')
    records, rejects = emr.read_emr(spark, f"{tmp_path}/p1")
    assert not [f for f in records.inputFiles() + rejects.inputFiles() if f.endswith(".json")]
    assert emr.flatten_emr(records, F.current_timestamp()).count() == 1 and rejects.count() == 1


def test_tokens_are_made_once(spark):
    docs = spark.createDataFrame([(1, "kidney kidney labs", ""), (2, None, "")], "doc_id int, text string, title string")
    posts = search.postings(search.tokenized(docs, []), [])
    assert sorted((r.doc_id, r.term, r.tf, r.doc_len) for r in posts.collect()) == [(1, "kidney", 2, 3), (1, "labs", 1, 3)]
    assert plan(posts).split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("split(") == 1


def test_distinct_labels_are_grounded_once(spark, monkeypatch):
    """Rows with a null label or kind get what ``ground`` gives them too."""
    seen, own = [], grounding.ground
    monkeypatch.setattr(grounding, "ground", lambda df, *more: seen.append(df.count()) or own(df, *more))
    labels = [("lab", "a1c"), ("lab", None), (None, "CKD"), (None, None), ("lab", " "), ("barrier", "Lisinopril refill issue")]
    rows = spark.createDataFrame([(i, *x) for i in range(10) for x in labels], "seq int, kind string, label string")
    got = grounding.ground_rows(rows)
    assert seen == [len(labels)]
    assert sorted(map(str, got.select(own(rows).columns).collect())) == sorted(map(str, own(rows).collect()))


def test_blank_and_generic_labels(spark):
    rows = spark.createDataFrame([("lab", x) for x in (None, "", " \t\u00a0\n", " Noted labs\u3000", "clinician NOTE", "noted labs x", "a")], "kind string, label string")
    judged = rows.select(facts.relevance(F.col("kind"), F.col("label")).alias("r"))
    assert [r.r for r in judged.collect()] == ["ignore"] * 3 + ["evidence_only"] * 2 + ["graph"] * 2
    assert "regexp_replace" not in plan(judged)  # nothing is trimmed to be judged


def test_signatures_of_one_label_alone_are_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(similarity, "cut_large", lambda df: stored.append(cut_large(df)) or stored[-1])
    labels = spark.createDataFrame([(p, "condition", n, True, True) for p in range(5) for n in ("Fibromyalgia syndrome", "Fibromyalgia syndromes", "CKD", "Asthma")],
                                   "patient_id int, block string, label string, left boolean, right boolean")
    pairs = similarity.similar_pairs(labels, 0.84, ("patient_id", "block"))
    assert {r.label for r in stored[0].select("label").distinct().collect()} == {"Fibromyalgia syndrome", "Fibromyalgia syndromes"}
    assert sorted(r.patient_id for r in pairs.collect()) == [0, 1, 2, 3, 4]


def test_terms_are_gathered_for_the_best_documents_only(spark, monkeypatch):
    seen, own = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda hits, *more: seen.append(hits.columns) or own(hits, *more))
    docs = spark.createDataFrame([(1, "kidney kidney labs", ""), (1, "kidney", ""), (2, "kidney labs", "x1"), (3, None, ""), (4, "labs", "")], "doc_id int, text string, title string")
    queries = spark.createDataFrame([("a", "labs kidney Kidney"), ("b", "nothing"), ("c", None), ("d", "labs")], "query_id string, query_text string")
    hits = sorted((r.query_id, r.rank, r.doc_id, r.matched_terms) for r in search.bm25(docs, queries, 2).collect())
    assert seen == [["query_id", "doc_id", "score"]]
    assert hits == [("a", 1, 1, ["kidney", "labs"]), ("a", 2, 2, ["kidney", "labs"]), ("d", 1, 4, ["labs"]), ("d", 2, 1, ["labs"])]


def test_events_get_their_vocabulary_by_slot(spark, tmp_path):
    """No row carries the vocabulary; events without an id, or with a negative one, keep their kind."""
    log = [(1, "purchase"), (7, "purchase"), (41, "click"), (37, "click"), (58, "view"), (None, "error"), (-5, "signup"), (2, None)]
    spark.createDataFrame([(i, t, 5, 250.0) for i, t in log], "event_id bigint, event_type string, user_id bigint, value double") \
        .withColumn("ts", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    events = activity.health_events(spark, str(tmp_path))
    assert sorted((r.seq or 0, r.kind, r.label or "", r.value or "") for r in events.collect()) == [
        (-5, "symptom", "", ""), (0, "condition", "", ""), (1, "lab", "eGFR", "65.0"), (2, "vital", "bp", "135/82"), (7, "lab", "eGFR", "65.0"),
        (37, "care_task", "Repeat HbA1c", ""), (41, "note", "Patient-reported context", ""), (58, "barrier", "Missed appointment", "")]
    assert "Generate" not in plan(events)


def test_stored_facts_hold_only_what_a_row_does_not_tell(spark, monkeypatch, make_events, make_sources):
    stored = []
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: stored.append(df.columns) or cut_large(df))
    events = make_events(dict(kind="lab", label="a1c", value="7.1"), dict(kind="lab", label="HbA1c", value="7.1"), dict(kind="condition", label="CKD", status="resolved", source="src_b"))
    sources = make_sources(("p1", "src_a", "emr", "x"), ("p1", "src_b", "voice", None))
    monkeypatch.setattr(catalog, "_events_sources", lambda *_: (events, sources))
    got, whole = catalog._stored_facts(spark, ""), catalog._facts(spark, "")
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 2
    assert not {"provenance", "fact_id", "valid_from", "recorded_at", "drug_classes", "coding_code"} & set(stored[0])


def test_tools_store_without_a_pass_for_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    rows = spark.createDataFrame([("p2", 1), ("p1", 2), (None, 3), ("p1", 4)], "patient_id string, x int")
    tools.write_by_patient(rows, f"{tmp_path}/rows")
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [1, 2, 3, 4]


def test_small_files_are_written_by_all_tasks_and_read_by_few(spark, tmp_path):
    """Few bytes in many files: the number of tasks does not follow the bytes, and nothing but the files is written."""
    rows = [(p, s, 0, n, None, n, f"{p} {s} {n}") for p in range(30) for s in ("a", "b") for n in range(3)]
    lines = spark.createDataFrame(rows, "patient_id long, specialty string, section_no int, part int, observed_at timestamp, seq long, text string").coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("small files", "written")
    reports.write_reports(lines, str(tmp_path / "r"))
    sc.setJobGroup("other", "")
    infos = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("small files") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(i.numTasks for i in infos if i) == files.task_count(spark) == 4
    assert len([f for f in (tmp_path / "r").rglob("*") if f.is_file()]) == 60
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # a partition for each file
        read = reports.read_reports(spark, str(tmp_path / "r"))
        assert read.rdd.getNumPartitions() == 4
        assert {(r.patient_id, r.specialty): r.body for r in read.collect()} == {(p, s): "\n".join(f"{p} {s} {n}" for n in range(3)) for p in range(30) for s in ("a", "b")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_names_of_small_files_give_their_keys(spark, tmp_path):
    odd = ["a/b", "x+y z", "100%", "v1.2", "a.txt", "ä=é", "%2F", "", None]
    lines = spark.createDataFrame([(i // 2, k, f"{k}") for i, k in enumerate(odd)], "a int, k string, value string")
    files.write_files(lines, str(tmp_path / "flat"), ["a", "k"])
    lines.write.partitionBy("a", "k").text(str(tmp_path / "nested"))  # where tasks do not reach the folder as a path
    for path in ("flat", "nested"):
        read = spark.read.text(str(tmp_path / path), wholetext=True).select("a", files.last_key("k", F.col("_metadata.file_path")).alias("k"), "value")
        assert sorted((r.a, r.k or "", r.value) for r in read.collect()) == sorted((i // 2, k or "", f"{k}\n") for i, k in enumerate(odd)), path
    assert sorted(f.name for f in (tmp_path / "flat" / "a=0").iterdir()) == ["k=a%2Fb.txt", "k=x+y z.txt"]
    with pytest.raises(FileExistsError):
        files.write_files(lines, str(tmp_path / "flat"), ["a", "k"])


def test_small_exports_become_few_records_files(spark, tmp_path):
    """One export a patient and 1,000 events, read back; the stored records are not one file for every few exports."""
    rows = [(i * 250, dt.datetime(2026, 1, 1), i % 8 if i else None, "purchase", float(i)) for i in range(64)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        found = catalog_ingest.emr_files(spark, str(tmp_path))
        assert 0 < len(found.inputFiles()) <= files.task_count(spark) == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = collections.Counter((i % 8, i // 4, "reject" if i % 8 in (3, 7) else "event") for i in range(1, 64) if (i * 250) % 41 and ((i * 250) % 37 == 0 or (i * 250) % 29))
    got = {(r.patient_id, r.part, r.found): r.n for r in found.groupBy("patient_id", "part", "found").agg(F.sum("n").alias("n")).collect()}
    kept = {k: 1 if k[2] == "reject" else n for k, n in want.items()}
    assert got == kept
