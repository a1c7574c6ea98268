"""Risk alerts.

Events are aggregated once per (patient, class, concept) into a summary that is small
for known concepts whatever the event count; the rule families are joins of that
summary with constant rule tables.  Evidence is a bridge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_number, stable_id
from carelattice.functions.values import diastolic, is_concerning, lab_flag, reading, systolic
from carelattice.lexicon import Lexicon
from carelattice.operators.grounding import ground, ground_rows, specialties_or_default
from carelattice.operators.trends import judge, trend_aggregates

SEVERITIES = ("high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def specialty_labels(specialties: Column) -> Column:
    return F.transform(specialties, lambda s: F.replace(s, F.lit("_"), F.lit(" ")))


def event_class(kind: Column) -> Column:
    return F.when(kind.isin("lab", "vital"), "measurement").otherwise(kind)


def concept_summary(events: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """One row per (patient, class, canonical) of medications, conditions and measurements."""
    g = ground_rows(events.filter(F.col("kind").isin("medication", "condition", "lab", "vital")), lex)
    g = g.withColumn("class", event_class(F.col("kind")))
    v = F.when(F.col("class") == "measurement", reading(F.col("value")))
    newest_first = F.struct((-F.unix_micros("observed_at")).alias("t"), F.col("seq"))
    latest = F.min_by(F.struct("event_id", "value", "unit", "observed_at"), newest_first)
    return g.groupBy("patient_id", "class", "canonical").agg(
        F.min("concept_id").alias("concept_id"), F.min("concept_kind").alias("concept_kind"),
        F.min("ref_unit").alias("ref_unit"), F.min("ref_low").alias("ref_low"), F.min("ref_high").alias("ref_high"),
        F.min("direction").alias("direction"), F.min("specialties").alias("specialties"),
        F.min("monitor_labs").alias("monitor_labs"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("event_id", "seq").alias("first_event"),
        latest.alias("latest"), *trend_aggregates(v))


def latest_readings(summary: DataFrame) -> DataFrame:
    """Latest reading per measurement (the first arrival among equal times), with its flag."""
    m = summary.filter(F.col("class") == "measurement")
    flag = lab_flag(F.col("concept_kind"), F.col("ref_low"), F.col("ref_high"), F.col("latest.value"))
    return m.select("patient_id", "canonical", F.col("latest.event_id").alias("event_id"),
                    F.col("latest.value").alias("value"), F.col("latest.unit").alias("unit"),
                    F.col("latest.observed_at").alias("observed_at"), flag.alias("flag"),
                    is_concerning(F.col("direction"), flag).alias("concerning"),
                    systolic(F.col("latest.value")).alias("systolic"),
                    diastolic(F.col("latest.value")).alias("diastolic"), "direction", "specialties", "first_seq")


def _alert(df: DataFrame, family: int, severity: Column, title: Column, horizon: Column, specialty: Column,
           explanation: Column, questions: Column, k1: str, k2: Column | None = None, rule_no: Column | None = None,
           rule_key: Column | None = None, **extra: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    seq_type = df.schema[k1].dataType
    fields = {"med_concept": F.lit(None).cast("int"), "canonical": none, "event_a": none, "event_b": none, **extra}
    return df.select(
        "patient_id", F.lit(family).alias("family"), severity.alias("severity"), title.alias("title"),
        horizon.alias("time_horizon"), specialty.alias("specialty"), explanation.alias("explanation"),
        questions.alias("questions"), F.col(k1).alias("k1"),
        (k2 if k2 is not None else F.lit(None).cast(seq_type)).alias("k2"),
        (rule_no if rule_no is not None else F.lit(0)).alias("rule_no"),
        (rule_key if rule_key is not None else none).alias("rule_key"),
        *[c.alias(n) for n, c in fields.items()])


def _soon(severity: Column) -> Column:
    return F.when(severity == "high", "Now").otherwise("Next 2 weeks")


def _texts(*items: str | Column) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


# The texts of this function must read as they do.
def contraindication_alerts(summary: DataFrame, lex: Lexicon) -> DataFrame:
    meds = summary.filter(F.col("class") == "medication").select(
        "patient_id", F.col("concept_id").alias("med_concept"), F.col("canonical").alias("med"),
        F.col("first_seq").alias("med_seq"), F.col("first_event").alias("med_event"))
    conds = summary.filter(F.col("class") == "condition").select(
        "patient_id", F.col("concept_id").alias("cond_concept"), F.col("canonical").alias("cond"),
        F.col("first_seq").alias("cond_seq"))
    hits = (meds.join(lex.contraindication_pairs(summary.sparkSession), "med_concept")
            .join(conds, ["patient_id", "cond_concept"])
            .groupBy("patient_id", "med_concept", "rule_no")
            .agg(F.min("med").alias("med"), F.min("med_seq").alias("med_seq"), F.min("med_event").alias("med_event"),
                 F.min_by("cond", "cond_seq").alias("cond"), F.min("severity").alias("severity"),
                 F.min("rule_id").alias("rule_id"), F.min("rule_specialties").alias("sp"),
                 F.min("rationale").alias("rationale"), F.min("questions").alias("q")))
    return _alert(hits, 1, F.col("severity"), F.concat("med", F.lit(" with "), "cond"), _soon(F.col("severity")),
                  specialty_labels(F.col("sp")), F.col("rationale"), F.col("q"), "med_seq", rule_no=F.col("rule_no"),
                  rule_key=F.concat_ws(":", F.lit("contra"), "rule_id", "med"), med_concept=F.col("med_concept"),
                  event_a=F.col("med_event"))


# The texts of this function must read as they do.
def interaction_alerts(summary: DataFrame, events: DataFrame, lex: Lexicon) -> DataFrame:
    """Ordered pairs (a, b) where some a precedes some b.  The witnesses are a's first event and
    the first b after it; a later b is looked up only where b also occurs before a."""
    meds = summary.filter(F.col("class") == "medication")
    a = meds.select("patient_id", F.col("concept_id").alias("concept_a"), F.col("canonical").alias("name_a"),
                    F.col("first_seq").alias("i"), F.col("first_event").alias("event_a"))
    b = meds.select("patient_id", F.col("concept_id").alias("concept_b"), F.col("canonical").alias("name_b"),
                    F.col("first_seq").alias("b_first"), F.col("last_seq").alias("b_last"),
                    F.col("first_event").alias("b_event"))
    pairs = (a.join(lex.interaction_pairs(summary.sparkSession), "concept_a").join(b, ["patient_id", "concept_b"])
             .filter(F.col("b_last") > F.col("i")))
    straight = pairs.filter(F.col("b_first") > F.col("i")).withColumn("j", F.col("b_first")) \
                    .withColumn("event_b", F.col("b_event"))
    woven = pairs.filter(F.col("b_first") < F.col("i"))
    later = ground(events.filter(F.col("kind") == "medication").select("patient_id", "event_id", "seq", "kind", "label"), lex) \
        .select("patient_id", F.col("concept_id").alias("concept_b"), "seq", F.col("event_id").alias("later_event"))
    starts = woven.select("patient_id", "concept_a", "concept_b", "i").distinct()
    first_later = (later.join(starts, ["patient_id", "concept_b"]).filter(F.col("seq") > F.col("i"))
                   .groupBy("patient_id", "concept_a", "concept_b")
                   .agg(F.min("seq").alias("j"), F.min_by("later_event", "seq").alias("event_b")))
    woven = woven.join(first_later, ["patient_id", "concept_a", "concept_b"])
    both = straight.unionByName(woven)
    return _alert(both, 2, F.col("severity"), F.concat("name_a", F.lit(" + "), "name_b", F.lit(" interaction")),
                  _soon(F.col("severity")), specialty_labels(F.col("rule_specialties")), F.col("rationale"),
                  F.col("questions"), "i", k2=F.col("j"), rule_no=F.col("rule_no"),
                  rule_key=F.concat_ws(":", F.lit("inter"), "rule_id", "name_a", "name_b"),
                  event_a=F.col("event_a"), event_b=F.col("event_b"))


def _unit_suffix(unit: Column) -> Column:
    return F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")


# The texts of this function must read as they do.
def range_alerts(summary: DataFrame) -> DataFrame:
    r = latest_readings(summary)
    is_bp = (F.col("canonical") == "Blood pressure") & F.col("systolic").isNotNull()
    s, d = F.col("systolic"), F.col("diastolic")
    high = r.filter(is_bp & ((s >= 140) | (d >= 90)))
    bp = _alert(high, 3, F.when((s >= 160) | (d >= 100), "high").otherwise("medium"),
                F.lit("Elevated blood pressure"), F.lit("Next 2 weeks"), _texts("primary care", "cardiology"),
                F.concat(F.lit("Most recent blood pressure was "), js_number(s), F.lit("/"), js_number(d),
                         F.lit(" mmHg, above the usual ≥140/90 threshold for concern.")),
                _texts("Is my blood pressure regimen still adequate?", "Should I monitor my blood pressure at home?"),
                "first_seq", rule_key=F.concat(F.lit("bp:"), "event_id"), event_a=F.col("event_id"))
    out = r.filter(~F.coalesce(is_bp, F.lit(False)) & F.col("concerning"))
    lab = _alert(out, 3, F.lit("medium"), F.concat("canonical", F.lit(" out of range")), F.lit("Next 2 weeks"),
                 specialty_labels(specialties_or_default(F.col("specialties"))),
                 F.concat(F.lit("Most recent "), "canonical", F.lit(" of "), "value", _unit_suffix(F.col("unit")),
                          F.lit(" is "), "flag", F.lit(" relative to its reference range.")),
                 _texts(F.concat(F.lit("What is causing my "), "canonical", F.lit(" to be "), "flag", F.lit("?")),
                        "Do I need a repeat test or treatment change?"),
                 "first_seq", rule_key=F.concat(F.lit("lab:"), "event_id"), event_a=F.col("event_id"))
    return bp.unionByName(lab)


# The texts of this function must read as they do.
def trend_alerts(summary: DataFrame) -> DataFrame:
    t = judge(summary.filter((F.col("class") == "measurement") & (F.col("points") >= 2))).filter("worsening")
    unit = F.when(F.coalesce(F.col("ref_unit"), F.lit("")) != "", F.col("ref_unit")).otherwise(F.col("last_unit"))
    return _alert(t, 4, F.lit("medium"), F.concat("canonical", F.lit(" worsening trend")), F.lit("Next 90 days"),
                  specialty_labels(specialties_or_default(F.coalesce("specialties", F.array().cast("array<string>")))),
                  F.concat("canonical", F.lit(" has moved "), "moved", F.lit(" from "), js_number(F.col("first_value")),
                           F.lit(" to "), js_number(F.col("last_value")), _unit_suffix(unit), F.lit(" across "),
                           F.col("points").cast("string"), F.lit(" readings, a clinically unfavorable direction.")),
                  _texts(F.concat(F.lit("Why is my "), "canonical", F.lit(" trending the wrong way?")),
                         "Does my treatment plan need to change?"),
                  "first_numeric_seq", rule_key=F.concat(F.lit("trend:"), "canonical"), canonical=F.col("canonical"))


def monitoring_gaps(summary: DataFrame, lex: Lexicon) -> DataFrame:
    """Medications none of whose monitored labs has any result for the patient."""
    meds = summary.filter((F.col("class") == "medication") & (F.size("monitor_labs") > 0)).select(
        "patient_id", F.col("concept_id").alias("med_concept"), "canonical", "first_seq", "first_event", "monitor_labs")
    labs = summary.filter((F.col("class") == "measurement") & F.col("concept_id").isNotNull()).select(
        "patient_id", F.col("concept_id").alias("lab_concept"), F.lit(1).alias("present"))
    covered = (meds.select("patient_id", "med_concept").join(lex.monitor_pairs(summary.sparkSession), "med_concept")
               .join(labs, ["patient_id", "lab_concept"], "left_semi").select("patient_id", "med_concept"))
    return meds.join(covered, ["patient_id", "med_concept"], "left_anti")


# The texts of this function must read as they do.
def gap_alerts(summary: DataFrame, lex: Lexicon) -> DataFrame:
    g = monitoring_gaps(summary, lex)
    return _alert(g, 5, F.lit("low"), F.concat(F.lit("Monitoring gap for "), "canonical"), F.lit("Next visit"),
                  _texts("pharmacy", "primary care"),
                  F.concat("canonical", F.lit(" typically requires monitoring of "), F.array_join("monitor_labs", ", "),
                           F.lit(", but no recent results are on file.")),
                  _texts(F.concat(F.lit("Should I have "), F.array_join("monitor_labs", " or "), F.lit(" checked?"))),
                  "first_seq", rule_key=F.concat(F.lit("monitor:"), "canonical"), event_a=F.col("first_event"))


# The texts of this function must read as they do.
def barrier_alerts(events: DataFrame) -> DataFrame:
    b = (events.filter(F.col("kind") == "barrier").groupBy("patient_id", F.lower("label").alias("_l"))
         .agg(F.min("seq").alias("seq"), F.min_by(F.struct("label", "event_id"), "seq").alias("f"))
         .select("patient_id", "seq", "f.label", "f.event_id"))
    return _alert(b, 6, F.lit("medium"), F.concat(F.lit("Care barrier: "), "label"), F.lit("Next appointment"),
                  _texts("primary care"),
                  F.concat(F.lit('A reported barrier ("'), "label",
                           F.lit('") may be interrupting needed care or medication.')),
                  _texts("Can you help me resolve this barrier to care?", "What should I do in the meantime?"),
                  "seq", rule_key=F.concat(F.lit("barrier:"), "event_id"), event_a=F.col("event_id"))


def risk_alerts(events: DataFrame, lex: Lexicon | None = None, summary: DataFrame | None = None) -> DataFrame:
    """All families, first alert per lower-cased title.  Order: (severity_rank, family, k1, k2, rule_no)."""
    lex = lex or Lexicon.default()
    summary = concept_summary(events, lex) if summary is None else summary
    every = (contraindication_alerts(summary, lex).unionByName(interaction_alerts(summary, events, lex))
             .unionByName(range_alerts(summary)).unionByName(trend_alerts(summary))
             .unionByName(gap_alerts(summary, lex)).unionByName(barrier_alerts(events)))
    cols = every.columns
    firsts = (every.groupBy("patient_id", F.lower("title").alias("alert_key"))
              .agg(F.min_by(F.struct(*cols), F.struct("family", "k1", "k2", "rule_no")).alias("_a"))
              .select("alert_key", "_a.*"))
    return firsts.withColumn("severity_rank", severity_rank(F.col("severity")))


def with_alert_id(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_id", stable_id("alert", F.concat_ws(":", F.col("patient_id").cast("string"), "rule_key")))


def alert_evidence(alerts: DataFrame, events: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Bridge (patient, alert, event); order by (part, seq)."""
    lex = lex or Lexicon.default()
    g = ground(events.filter(F.col("kind").isin("condition", "lab", "vital"))
               .select("patient_id", "event_id", "seq", "kind", "label"), lex)
    none = F.lit(None).cast(events.schema["seq"].dataType)
    direct = alerts.select("patient_id", "alert_key", F.posexplode(F.filter(
        F.array("event_a", "event_b"), lambda e: e.isNotNull())).alias("part", "event_id")).withColumn("seq", none)
    contra = (alerts.filter(F.col("family") == 1).select("patient_id", "alert_key", "med_concept", "rule_no")
              .join(lex.contraindication_pairs(events.sparkSession).select("med_concept", "rule_no", "cond_concept"),
                    ["med_concept", "rule_no"]))
    conds = g.filter(F.col("kind") == "condition").select(
        "patient_id", F.col("concept_id").alias("cond_concept"), "event_id", "seq")
    matched = conds.join(contra, ["patient_id", "cond_concept"]).select(
        "patient_id", "alert_key", F.lit(1).alias("part"), "event_id", "seq")
    series = g.filter(F.col("kind") != "condition").select("patient_id", "canonical", "event_id", "seq").join(
        alerts.filter(F.col("family") == 4).select("patient_id", "alert_key", "canonical"), ["patient_id", "canonical"])
    return direct.unionByName(matched).unionByName(
        series.select("patient_id", "alert_key", F.lit(0).alias("part"), "event_id", "seq"))


def alert_source_types(evidence: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct source types behind each alert."""
    e = events.select("patient_id", "event_id", "source_id")
    s = sources.select("patient_id", "source_id", "source_type")
    return (evidence.select("patient_id", "alert_key", "event_id").join(e, ["patient_id", "event_id"])
            .select("patient_id", "alert_key", "source_id").distinct().join(s, ["patient_id", "source_id"])
            .select("patient_id", "alert_key", "source_type").distinct())


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "high").alias("high_alerts"))


def alert_totals(rules: DataFrame, extra: DataFrame) -> DataFrame:
    """(patient_id, rule_alerts, extra_alerts, method) of every patient with an alert."""
    counted = rules.select("patient_id", F.lit(1).alias("rule")).unionByName(extra.select("patient_id", F.lit(0).alias("rule")))
    n = counted.groupBy("patient_id").agg(F.sum("rule").alias("rule_alerts"), F.sum(1 - F.col("rule")).alias("extra_alerts"))
    return n.withColumn("method", F.when(F.col("extra_alerts") > 0, "rules+extra").otherwise("rules"))
