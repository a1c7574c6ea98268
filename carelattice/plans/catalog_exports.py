"""Workspaces and reports written to files and read back, as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelattice.operators import reports as rp
from carelattice.plans import oracles as o
from carelattice.plans.activity import health_events, health_sources
from carelattice.plans.catalog import REPORT, _briefs, register
from carelattice.plans.catalog_more import fresh_folder
from carelattice.sources import workspace as ws

# -- workspace -----------------------------------------------------------------------------------

WORKSPACE = """src AS (SELECT *, CASE WHEN source_type = 'voice' AND patient_id % 4 = 0 THEN 'fax' ELSE source_type END AS type FROM sources),
good AS (SELECT * FROM src WHERE type <> 'fax'),
fc AS (SELECT h.*, CASE WHEN seq % 11 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS c FROM he h)"""


@register("workspace_reload", o.with_(o.HE, o.SOURCES, WORKSPACE) + """SELECT CAST(f.patient_id AS VARCHAR) AS user_id, 'fact' AS part, f.event_id AS id, CASE WHEN f.seq % 4 = 0 THEN 'second' ELSE f.label END AS label, g.title AS detail
  FROM fc f JOIN good g ON g.patient_id = f.patient_id AND g.source_id = f.source_id WHERE f.c <= 1
 UNION ALL SELECT CAST(patient_id AS VARCHAR), 'reject', source_id, title, 'check' FROM src WHERE type = 'fax'
 UNION ALL SELECT CAST(f.patient_id AS VARCHAR), 'reject', f.event_id, f.label, CASE WHEN f.c > 1 THEN 'check' ELSE 'reference' END FROM fc f LEFT JOIN good g ON g.patient_id = f.patient_id AND g.source_id = f.source_id WHERE f.c > 1 OR g.source_id IS NULL
 UNION ALL SELECT DISTINCT CAST(patient_id AS VARCHAR), 'profile', CAST(patient_id AS VARCHAR), concat('Patient ', patient_id), NULL FROM he""")
def workspace_reload(spark, sf):
    """Profiles, sources and facts are written, a quarter of the facts again; rejects come from checks and missing sources; all is read back, facts with their sources."""
    e = health_events(spark, sf)
    user, name, root = F.col("patient_id").cast("string").alias("user_id"), f"w{uuid.uuid4().hex}", fresh_folder(spark)
    people = e.select("patient_id").distinct()
    ws.write(name, root, "profiles", people.select(F.col("patient_id").cast("string").alias("id"), F.concat(F.lit("Patient "), "patient_id").alias("name"), F.lit(0).alias("n")), "n")
    kind = F.when((F.col("source_type") == "voice") & (F.col("patient_id") % 4 == 0), "fax").otherwise(F.col("source_type"))
    sources = health_sources(e).select(user, F.col("source_id").alias("id"), kind.alias("type"), "title", "captured_at", "raw_text", F.lit(0).alias("n"))
    bad_sources = ws.write(name, root, "sources", sources, "n")
    confidence = F.when(F.col("seq") % 11 == 0, 1.5).otherwise(0.5)
    facts = e.select(user, F.concat("event_id", F.lit("")).alias("id"), "event_id", "source_id", "kind", "label", "value", "unit", "observed_at", "status",
                     confidence.alias("confidence"), F.lit("graph").alias("relevance"), F.lit("accepted").alias("review_status"), F.col("seq").alias("n"))
    bad_facts = ws.write(name, root, "clinical_facts", facts, "n")
    ws.write(name, root, "clinical_facts", facts.filter("n % 4 = 0").withColumn("label", F.lit("second")), "n")
    stored = ws.facts_with_sources(spark, name).select("user_id", F.lit("fact").alias("part"), "id", "label", F.col("title").alias("detail"))
    profiles = ws.current(spark, name, "profiles").select(F.col("id").alias("user_id"), F.lit("profile").alias("part"), "id", F.col("name").alias("label"), F.lit(None).cast("string").alias("detail"))
    rejects = bad_sources.select("user_id", "id", F.col("title").alias("label"), "reason").unionByName(bad_facts.select("user_id", "id", "label", "reason"))
    return stored.unionByName(profiles).unionByName(rejects.select("user_id", F.lit("reject").alias("part"), "id", "label", F.col("reason").alias("detail")))


# -- reports as text files -----------------------------------------------------------------------

LISTS = """li AS (SELECT patient_id, CASE kind WHEN 'medication' THEN 2 ELSE 4 END AS section_no, CASE kind WHEN 'barrier' THEN 1 WHEN 'care_task' THEN 2 ELSE 0 END AS part, observed_at, seq,
   concat('- ', label, CASE WHEN coalesce(value, '') <> '' THEN concat(': ', value) ELSE '' END) AS text FROM he WHERE kind IN ('medication', 'symptom', 'barrier', 'care_task')
 UNION ALL (SELECT patient_id, 3, 0, observed_at, seq, concat('- ', label, ': ', coalesce(value, ''), CASE WHEN coalesce(unit, '') <> '' THEN concat(' ', unit) ELSE '' END, ' (', month(observed_at), '/', day(observed_at), '/', year(observed_at), ')') FROM he WHERE kind IN ('lab', 'vital')
   QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY observed_at DESC, seq) <= 12)
 UNION ALL SELECT patient_id, 6, 0, captured_at, NULL, concat('- ', title, ' (', source_type, ')') FROM sources)"""
MERGED = f"""mg AS (SELECT patient_id, specialty, title, CASE WHEN patient_id % 3 = 0 THEN 'As extracted.' ELSE summary END AS summary,
   CASE WHEN patient_id % 3 = 0 THEN ['First concern', 'Second concern'] ELSE concerns END AS concerns, questions FROM rep),
ln AS (SELECT patient_id, specialty, -1 AS section_no, 0 AS part, NULL::TIMESTAMP AS observed_at, NULL::BIGINT AS seq, title AS text FROM mg
 UNION ALL SELECT patient_id, specialty, -1, 1, NULL, NULL, repeat('=', length(title)) FROM mg
 UNION ALL SELECT patient_id, specialty, n, -1, NULL, NULL, heading FROM mg CROSS JOIN {o.values(enumerate(rp.SECTIONS))} h(n, heading)
 UNION ALL SELECT patient_id, specialty, 0, 0, NULL, NULL, summary FROM mg
 UNION ALL SELECT patient_id, specialty, 1, unnest(range(len(concerns))), NULL, NULL, unnest(list_transform(concerns, lambda c, i: concat(i, '. ', c))) FROM mg
 UNION ALL SELECT patient_id, specialty, 5, unnest(range(len(questions))), NULL, NULL, unnest(list_transform(questions, lambda c, i: concat(i, '. ', c))) FROM mg
 UNION ALL SELECT patient_id, specialty, 7, 0, NULL, NULL, {o.lit(rp.DISCLAIMER)} FROM mg
 UNION ALL SELECT li.patient_id, mg.specialty, section_no, part, observed_at, seq, text FROM li JOIN mg USING (patient_id))"""


@register("report_files", o.with_(o.GROUND, o.SOURCES, o.TRENDS, o.ALERTS, REPORT, LISTS, MERGED)
          + "SELECT patient_id, specialty, string_agg(text, chr(10) ORDER BY section_no, part, observed_at DESC, seq, text) AS body FROM ln GROUP BY 1, 2")
def report_files(spark, sf):
    """Template briefs with extracted texts merged in, written as one text file a report and read back whole."""
    briefs, e = _briefs(spark, sf)
    third = briefs.filter("patient_id % 3 = 0").select("patient_id", "specialty", F.lit("As extracted.").alias("summary"),
                                                       F.array(F.lit("First concern"), F.lit("Second concern")).alias("top_concerns"), F.array().cast("array<string>").alias("questions"))
    path = fresh_folder(spark)
    rp.write_reports(rp.report_lines(rp.merge_extracted(briefs, third), rp.report_lists(e, health_sources(e))), path)
    read = rp.read_reports(spark, path)
    return read.select(F.col("patient_id").cast("bigint").alias("patient_id"), "specialty", "body")
