"""Specialty visit briefs and patient digests.

Bounded parts (summary sentence, top concerns, questions) are one row per patient and
specialty.  Lists that grow with the record (medications, context, sources) stay as rows
in display order, so a patient of any size can be reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carelattice.functions.text import describe_list, distinct_exact, js_number, js_trim
from carelattice.functions.values import is_concerning, lab_flag
from carelattice.lexicon import Lexicon
from carelattice.operators.grounding import ground
from carelattice.operators.trends import trend_summary
from carelattice.session import cut_lineage
from carelattice.sources.files import in_few_tasks, last_key, write_files

# --- fixed values -----------------------------------------------------------
SPECIALTY_TITLES = [("primary_care", "Primary Care"), ("cardiology", "Cardiology"), ("nephrology", "Nephrology"),
                    ("endocrinology", "Endocrinology"), ("pharmacy", "Pharmacy / Medication Review")]
CONCERNS, QUESTIONS, TIMELINE, LABS, SHOWN = 5, 5, 10, 12, 4
DIGEST_READINGS, DIGEST_SYMPTOMS = 14, 10
DISCLAIMER = ("Generated from patient-provided and imported data. Not a diagnosis. "
              "Clinician review required.")
SECTIONS = ["PATIENT SNAPSHOT", "TOP CONCERNS", "CURRENT MEDICATIONS", "RECENT LABS & VITALS", "PATIENT-REPORTED CONTEXT",
            "QUESTIONS FOR THIS VISIT", "EVIDENCE SOURCES", "DISCLAIMER"]
# --- end of fixed values ----------------------------------------------------


def newest(seq: str = "seq") -> list[Column]:
    return [F.col("observed_at").desc(), F.col(seq)]


def recent_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The newest events of each patient; the rank limit works before the shuffle."""
    w = W.partitionBy("patient_id").orderBy(*newest())
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def timeline(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Every patient's events newest first, with the title of their source and their place in the patient's list.

    Rows are sorted by ranges of patient and time and numbered within a range; a patient who spans several ranges adds the
    counts of the earlier ones, so no patient has to fit one task."""
    rows = events.join(sources.select("patient_id", "source_id", F.col("title").alias("source_title")), ["patient_id", "source_id"], "left")
    ordered = cut_lineage(rows.repartitionByRange("patient_id", *newest()).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("patient_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("patient_id", "_part", (F.sum("_n").over(W.partitionBy("patient_id").orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(W.partitionBy("patient_id", "_part").orderBy(*newest()))
    return (ordered.withColumn("_r", here).join(before, ["patient_id", "_part"])
            .withColumn("place", F.col("_before") + F.col("_r")).drop("_part", "_r", "_before"))


def first_n(rows: DataFrame, group: list[str], order: list[Column], n: int, text: str, out: str) -> DataFrame:
    """Per group the first ``n`` texts as an ordered array.  The rank limit is applied before the
    shuffle, so at most n rows of a group ever meet."""
    r = rows.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= n)
    return r.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda s: s[text]).alias(out))


def first_distinct(rows: DataFrame, group: list[str], n: int, text: str, out: str) -> DataFrame:
    """Like ``first_n`` for distinct texts in newest-first order of their first appearance, with their count."""
    u = rows.groupBy(*group, text).agg(F.min(F.struct((-F.unix_micros("observed_at")).alias("t"), "seq")).alias("_o"))
    counts = u.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{out}_n"))
    return first_n(u, group, [F.col("_o")], n, text, out).join(counts, group)


def is_relevant(kind: Column, concept_specialties: Column, specialty: Column) -> Column:
    return (F.when(specialty == "primary_care", F.lit(True))
            .when(specialty == "pharmacy", kind.isin("medication", "lab"))
            .otherwise(F.coalesce(F.array_contains(concept_specialties, specialty), F.lit(False))))


def alerts_for_specialty(alerts: DataFrame) -> DataFrame:
    """Alerts repeated for each specialty they concern; primary care sees all."""
    key = F.element_at(F.split("specialty_key", "_"), 1)
    tagged = alerts.select("*", F.explode(F.array(*[F.lit(s) for s, _ in SPECIALTY_TITLES])).alias("specialty_key"))
    return tagged.filter((F.col("specialty_key") == "primary_care")
                         | F.exists("specialty", lambda s: F.contains(F.lower(s), key)))


def abnormal_measurements(g: DataFrame) -> DataFrame:
    flag = lab_flag(F.col("concept_kind"), F.col("ref_low"), F.col("ref_high"), F.col("value"))
    return g.filter(F.col("kind").isin("lab", "vital") & is_concerning(F.col("direction"), flag))


def _arrow(t: DataFrame) -> Column:
    return F.concat(js_number(F.col("first_value")), F.lit("→"), js_number(F.col("last_value")))


def _unit(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" "), F.col(c))).otherwise("")


def report_briefs(patients: DataFrame, events: DataFrame, alerts: DataFrame, lex: Lexicon | None = None,
                  grounded: DataFrame | None = None) -> DataFrame:
    """(patient_id, specialty, title, summary, top_concerns, questions) for every patient and specialty."""
    g = ground(events, lex) if grounded is None else grounded
    p = ["patient_id"]
    conditions, meds = g.filter(F.col("kind") == "condition"), g.filter(F.col("kind") == "medication")
    barriers = g.filter(F.col("kind") == "barrier")
    worse = trend_summary(g, lex, grounded=True).filter("worsening").withColumn("observed_at", F.col("last_observed_at"))
    worse = worse.withColumns({"text": F.concat("label", F.lit(" "), _arrow(worse), _unit("unit")),
                               "concern": F.concat("label", F.lit(" trending unfavorably ("), _arrow(worse), F.lit(")"))})
    abnormal = abnormal_measurements(g)
    value = F.coalesce("value", F.lit(""))
    abnormal = abnormal.withColumns({
        "text": F.concat("normalized_label", F.lit(" "), value),
        "concern": F.concat("normalized_label", F.lit(" out of range ("), value, F.lit(")"))})
    quiet = abnormal.join(worse.select("patient_id", F.col("label").alias("normalized_label")),
                          ["patient_id", "normalized_label"], "left_anti")
    counts = g.groupBy(*p).agg(F.count_if(F.col("kind") == "condition").alias("conditions_n"),
                               F.count_if(F.col("kind") == "medication").alias("meds_n"),
                               F.count_if(F.col("kind") == "barrier").alias("barriers_n"))
    parts = [
        counts, first_n(conditions, p, newest(), SHOWN, "normalized_label", "conditions"),
        first_n(meds, p, newest(), SHOWN, "normalized_label", "meds"),
        first_n(barriers, p, newest(), SHOWN, "label", "barriers"),
        first_n(worse, p, newest("newest_seq"), CONCERNS, "text", "worse"),
        worse.groupBy(*p).agg(F.count(F.lit(1)).alias("worse_n")),
        first_n(worse, p, newest("newest_seq"), CONCERNS, "concern", "worse_concerns"),
        first_n(abnormal, p, newest(), SHOWN, "text", "abnormal"),
        abnormal.groupBy(*p).agg(F.count(F.lit(1)).alias("abnormal_n")),
        first_distinct(quiet, p, CONCERNS, "concern", "quiet"),
        first_distinct(g.filter(F.col("kind") == "symptom"), p, SHOWN, "normalized_label", "symptoms"),
        first_distinct(barriers, p, CONCERNS, "label", "barrier_labels"),
    ]
    base = patients.select("patient_id", "name")
    for part in parts:
        base = base.join(part, p, "left")
    rows = base.select("*", F.inline(F.array(*[F.struct(F.lit(s).alias("specialty"), F.lit(t).alias("specialty_title"))
                                               for s, t in SPECIALTY_TITLES])))
    ps = ["patient_id", "specialty"]
    by_spec = conditions.select("patient_id", "observed_at", "seq", "normalized_label",
                                F.explode("specialties").alias("specialty")).filter(
        F.col("specialty").isin("cardiology", "nephrology", "endocrinology"))
    rows = rows.join(first_n(by_spec, ps, newest(), SHOWN, "normalized_label", "relevant"), ps, "left")
    rows = rows.join(by_spec.groupBy(*ps).agg(F.count(F.lit(1)).alias("relevant_n")), ps, "left")
    mine = alerts_for_specialty(alerts).drop("specialty").withColumnRenamed("specialty_key", "specialty")
    order = [F.col("severity_rank"), F.col("family"), F.col("k1"), F.col("k2"), F.col("rule_no")]
    rows = rows.join(first_n(mine, ps, order, CONCERNS, "title", "alert_titles"), ps, "left")
    asked = mine.select(*ps, F.struct("severity_rank", "family", "k1", "k2", "rule_no").alias("o"),
                        F.posexplode("questions").alias("pos", "question")).groupBy(*ps, "question").agg(
        F.min(F.struct("o", "pos")).alias("_o"))
    rows = rows.join(first_n(asked, ps, [F.col("_o")], QUESTIONS, "question", "asked"), ps, "left")

    n = lambda c: F.coalesce(c, F.lit(0))
    is_primary = F.col("specialty") == "primary_care"
    # primary care regards every condition as relevant
    relevant = F.when(is_primary, F.col("conditions")).otherwise(F.col("relevant"))
    # The sentences below must read as they do.
    summary = F.array_join(F.filter(F.array(
        F.when(n("conditions_n") > 0, F.concat("name", F.lit(" has a history of "),
                                               describe_list(F.col("conditions"), F.col("conditions_n")), F.lit(".")))
        .otherwise(F.concat("name", F.lit("'s record does not list established diagnoses yet."))),
        F.when(n("meds_n") > 0, F.concat(F.lit("Current medications include "),
                                         describe_list(F.col("meds"), F.col("meds_n")), F.lit("."))),
        F.when(n("worse_n") > 0, F.concat(F.lit("Worsening trends: "), describe_list(F.col("worse"), F.col("worse_n")), F.lit(".")))
        .when(n("abnormal_n") > 0, F.concat(F.lit("Out-of-range results: "),
                                            describe_list(F.col("abnormal"), F.col("abnormal_n")), F.lit("."))),
        F.when(n("symptoms_n") > 0, F.concat(F.lit("Reported symptoms: "),
                                             describe_list(F.col("symptoms"), F.col("symptoms_n")), F.lit("."))),
        F.when(n("barriers_n") > 0, F.concat(F.lit("Care barriers noted: "),
                                             describe_list(F.col("barriers"), F.col("barriers_n")), F.lit("."))),
        F.when(~is_primary & (n("relevant_n") > 0), F.concat(
            F.lit("Most relevant to "), F.lower("specialty_title"), F.lit(": "),
            describe_list(F.col("relevant"), F.col("relevant_n")), F.lit("."))),
    ), lambda x: x.isNotNull()), " ")
    none = F.array().cast("array<string>")
    concerns = F.slice(distinct_exact(F.concat(
        F.coalesce("alert_titles", none), F.coalesce("worse_concerns", none), F.coalesce("quiet", none),
        F.transform(F.coalesce("barrier_labels", none), lambda b: F.concat(F.lit("Care barrier: "), b)))), 1, CONCERNS)
    questions = F.when(F.size(F.coalesce("asked", none)) > 0, F.col("asked")).otherwise(
        default_questions(F.get(relevant, F.lit(0)), F.col("specialty_title")))
    return rows.select(*ps, F.concat("specialty_title", F.lit(" Visit Brief — "), "name").alias("title"),
                       summary.alias("summary"), concerns.alias("top_concerns"), questions.alias("questions"))


def default_questions(first_condition: Column, specialty_title: Column) -> Column:
    focus = F.coalesce(first_condition, F.lit("my overall health"))
    return F.array(F.concat(F.lit("What should I prioritize for "), focus, F.lit(" before the next visit?")),
                   F.lit("Are any of my medications interacting or unnecessary?"),
                   F.lit("Which symptoms should prompt urgent attention?"),
                   F.concat(F.lit("What follow-up or tests do you recommend from a "), F.lower(specialty_title),
                            F.lit(" perspective?")))


def report_timeline(g: DataFrame) -> DataFrame:
    """The ten newest relevant events per patient and specialty (grounded events in)."""
    tagged = g.select("*", F.explode(F.array(*[F.lit(s) for s, _ in SPECIALTY_TITLES])).alias("specialty"))
    keep = F.when(F.col("specialty") == "primary_care", F.col("kind") != "note").otherwise(
        is_relevant(F.col("concept_kind"), F.col("specialties"), F.col("specialty")) | (F.col("kind") == "barrier"))
    w = W.partitionBy("patient_id", "specialty").orderBy(*newest())
    return (tagged.filter(keep).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TIMELINE)
            .select("patient_id", "specialty", "rank", "event_id", "kind", "label", "value", "unit", "observed_at"))


def report_lists(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the open-ended sections, one per item: medications, the twelve newest labs and vitals,
    patient context, evidence sources.  Order by (section_no, part, observed_at desc, seq)."""
    section = (F.when(F.col("kind") == "medication", 2).when(F.col("kind").isin("symptom", "barrier", "care_task"), 4))
    part = F.when(F.col("kind") == "symptom", 0).when(F.col("kind") == "barrier", 1).when(F.col("kind") == "care_task", 2) \
            .otherwise(0)
    has_value = F.coalesce(F.col("value"), F.lit("")) != ""
    text = F.concat(F.lit("- "), "label", F.when(has_value, F.concat(F.lit(": "), "value")).otherwise(""))
    cols = ["patient_id", "section_no", "part", "observed_at", "seq", "text"]
    plain = events.withColumns({"section_no": section, "part": part, "text": text}).filter(F.col("section_no").isNotNull())
    w = W.partitionBy("patient_id").orderBy(*newest())
    labs = events.filter(F.col("kind").isin("lab", "vital")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= LABS)
    labs = labs.withColumns({
        "section_no": F.lit(3), "part": F.lit(0),
        "text": F.concat(F.lit("- "), "label", F.lit(": "), F.coalesce("value", F.lit("")), _unit("unit"), F.lit(" ("),
                         F.date_format("observed_at", "M/d/yyyy"), F.lit(")"))})
    used = sources.join(events.select("patient_id", "source_id").distinct(), ["patient_id", "source_id"], "left_semi")
    seq_type = events.schema["seq"].dataType
    src = used.select("patient_id", F.lit(6).alias("section_no"), F.lit(0).alias("part"), F.col("captured_at").alias("observed_at"),
                      F.lit(None).cast(seq_type).alias("seq"),
                      F.concat(F.lit("- "), "title", F.lit(" ("), "source_type", F.lit(")")).alias("text"))
    return plain.select(*cols).unionByName(labs.select(*cols)).unionByName(src)


def report_lines(briefs: DataFrame, lists: DataFrame) -> DataFrame:
    """The plain-text brief as ordered lines: (patient_id, specialty, section_no, part, observed_at, seq, text).
    Part -1 is a section heading; sort ascending, observed_at descending."""
    at, seq = F.lit(None).cast("timestamp"), F.lit(None).cast(lists.schema["seq"].dataType)

    def numbered(items: str) -> Column:
        return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))

    def rows(section: int, texts: Column) -> DataFrame:
        return briefs.select("patient_id", "specialty", F.lit(section).alias("section_no"),
                             F.posexplode(texts).alias("part", "text")).select(
            "patient_id", "specialty", "section_no", "part", at.alias("observed_at"), seq.alias("seq"), "text")

    out = rows(-1, F.array(F.col("title"), F.repeat(F.lit("="), F.length("title"))))
    heads = briefs.select("patient_id", "specialty", F.posexplode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section_no", "text"))
    out = out.unionByName(heads.select("patient_id", "specialty", "section_no", F.lit(-1).alias("part"), at.alias("observed_at"),
                                       seq.alias("seq"), "text"))
    out = out.unionByName(rows(0, F.array("summary"))).unionByName(rows(1, numbered("top_concerns")))
    out = out.unionByName(rows(5, numbered("questions"))).unionByName(rows(7, F.array(F.lit(DISCLAIMER))))
    mine = lists.join(briefs.select("patient_id", "specialty"), "patient_id")
    return out.unionByName(mine.select(*out.columns))


def write_reports(lines: DataFrame, path: str) -> None:
    """report_lines() as text files, one a report, its lines in order: ``path``/patient_id=../specialty=...txt."""
    write_files(lines.withColumnRenamed("text", "value"), path, ["patient_id", "specialty"],
                ["section_no", "part", F.col("observed_at").desc(), "seq", "value"])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, specialty, body) of written reports."""
    whole = in_few_tasks(spark.read.text(path, wholetext=True))
    return whole.select("patient_id", last_key("specialty", F.col("_metadata.file_path")).alias("specialty"), F.regexp_replace("value", r"\n\z", "").alias("body"))


def merge_extracted(briefs: DataFrame, extracted: DataFrame, conversation: DataFrame | None = None) -> DataFrame:
    """Extracted summary, concerns and questions replace the template's where non-empty;
    a conversation's summary is attached where the patient has one."""
    x = extracted.select("patient_id", "specialty", F.col("summary").alias("x_s"), F.col("top_concerns").alias("x_c"),
                         F.col("questions").alias("x_q"))
    j = briefs.join(x, ["patient_id", "specialty"], "left")
    out = j.withColumns({
        "summary": F.coalesce(F.nullif("x_s", F.lit("")), "summary"),
        "top_concerns": F.when(F.size("x_c") > 0, F.col("x_c")).otherwise(F.col("top_concerns")),
        "questions": F.when(F.size("x_q") > 0, F.col("x_q")).otherwise(F.col("questions"))}).drop("x_s", "x_c", "x_q")
    return out if conversation is None else out.join(
        conversation.select("patient_id", F.col("summary").alias("conversation_summary")), "patient_id", "left")


# -- digest ------------------------------------------------------------------------------------

def value_text() -> Column:
    has = F.coalesce(js_trim(F.col("value")), F.lit("")) != ""
    return F.concat("label", F.when(has, F.concat(F.lit(" "), "value", _unit("unit"))).otherwise(""))


def patient_digest(events: DataFrame) -> DataFrame:
    """Digest items in long form: (patient_id, section, seq, text), read in seq order per section.
    Conditions and medications list all distinct items, readings the latest per label among the last
    fourteen labels, symptoms the first ten distinct labels."""
    open_ = F.coalesce(F.col("status") != "resolved", F.lit(True))
    ok = F.coalesce(js_trim(F.col("text")), F.lit("")) != ""

    def distinct(kind: str, text: Column, section: str, keep: Column | None = None) -> DataFrame:
        rows = events.filter(F.col("kind") == kind)
        if keep is not None:
            rows = rows.filter(keep)
        rows = rows.withColumn("text", text).filter(ok)
        return rows.groupBy("patient_id", "text").agg(F.min("seq").alias("seq")).withColumn("section", F.lit(section))

    conditions = distinct("condition", F.col("label"), "Active conditions", open_)
    meds = distinct("medication", value_text(), "Current medications", open_)
    symptoms = distinct("symptom", F.col("label"), "Reported symptoms")
    ws = W.partitionBy("patient_id").orderBy("seq")
    symptoms = symptoms.withColumn("_r", F.row_number().over(ws)).filter(F.col("_r") <= DIGEST_SYMPTOMS).drop("_r")
    m = events.filter(F.col("kind").isin("lab", "vital"))
    order = F.struct("observed_at", "seq")
    latest = m.groupBy("patient_id", "label").agg(
        F.min(order).alias("entered"), F.max_by(F.struct("label", "value", "unit", "observed_at", "seq"), order).alias("l"))
    wl = W.partitionBy("patient_id").orderBy(F.col("entered").desc())
    latest = latest.withColumn("_r", F.row_number().over(wl)).filter(F.col("_r") <= DIGEST_READINGS)
    readings = latest.select("patient_id", "l.*", F.col("entered.seq").alias("first_seq")).select(
        "patient_id", F.concat(value_text(), F.lit(" ("), F.date_format("observed_at", "MMM yyyy"), F.lit(")")).alias("text"),
        F.col("first_seq").alias("seq"), F.lit("Recent labs & vitals").alias("section"))
    cols = ["patient_id", "section", "seq", "text"]
    return (conditions.select(*cols).unionByName(meds.select(*cols)).unionByName(readings.select(*cols))
            .unionByName(symptoms.select(*cols)))
