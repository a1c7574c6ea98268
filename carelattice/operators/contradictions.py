"""Contradictions between sources: conflicting status and divergent same-day values.

Members of a contradiction stay in long form (one row per fact): a concept may hold
an unbounded number of facts, so no id list is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_number, stable_id
from carelattice.functions.values import reading

DIVERGENCE = 0.25  # fixed value: largest tolerated relative spread within a day


def _graph_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("relevance") == "graph").withColumn(
        "concept_key", F.concat_ws(":", "concept_kind", F.lower("canonical")))


def _concepts(facts: DataFrame) -> DataFrame:
    return (_graph_facts(facts).groupBy("patient_id", "concept_key")
            .agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("source_id").alias("sources"),
                 F.max(F.col("status") == "active").alias("any_active"),
                 F.max(F.col("status") == "resolved").alias("any_resolved"),
                 F.min_by("normalized_label", "seq").alias("first_label"),
                 F.min_by("kind", "seq").alias("first_kind"))
            .filter((F.col("facts") >= 2) & (F.col("sources") >= 2))
            .withColumn("conflicting", F.coalesce(F.col("any_active") & F.col("any_resolved"), F.lit(False))))


def status_contradictions(facts: DataFrame) -> DataFrame:
    return _concepts(facts).filter("conflicting").select(
        "patient_id", "concept_key", F.lit("active-vs-resolved").alias("tag"), "facts", "sources",
        F.lit(None).cast("date").alias("day"),
        F.concat(F.lit("Conflicting status across sources for "), F.col("first_label"),
                 F.lit(": reported both active and resolved.")).alias("reason"))


def value_contradictions(facts: DataFrame) -> DataFrame:
    """The first divergent day (by arrival) of each multi-source measurement without a status conflict."""
    candidates = (_concepts(facts).filter(~F.col("conflicting") & F.col("first_kind").isin("lab", "vital"))
                  .select("patient_id", "concept_key", "first_label", "sources"))
    days = (_graph_facts(facts).withColumn("_v", reading(F.col("value"))).withColumn("day", F.to_date("observed_at"))
            .groupBy("patient_id", "concept_key", "day")
            .agg(F.min("seq").alias("_arrival"), F.count(F.lit(1)).alias("facts"), F.count("_v").alias("_n"),
                 F.min("_v").alias("_min"), F.max("_v").alias("_max"))
            .filter((F.col("_n") >= 2) & (F.col("_min") > 0)
                    & ((F.col("_max") - F.col("_min")) / F.col("_min") > DIVERGENCE)))
    first_day = (days.groupBy("patient_id", "concept_key")
                 .agg(F.min_by(F.struct("day", "facts", "_min", "_max"), "_arrival").alias("d")))
    return (first_day.join(candidates, ["patient_id", "concept_key"])
            .select("patient_id", "concept_key", F.lit("divergent-values").alias("tag"), F.col("d.facts").alias("facts"),
                    "sources", F.col("d.day").alias("day"),
                    F.concat(F.lit("Divergent same-day values for "), F.col("first_label"), F.lit(" ("),
                             js_number(F.col("d._min")), F.lit(" vs "), js_number(F.col("d._max")), F.lit(")."))
                    .alias("reason")))


def contradictions(facts: DataFrame) -> DataFrame:
    """Review rows of both kinds; the id is keyed by patient, concept and tag."""
    both = status_contradictions(facts).unionByName(value_contradictions(facts))
    return both.withColumn("target_type", F.lit("contradiction")).withColumn(
        "review_id", stable_id("review", F.concat_ws(":", F.lit("contradiction"), F.col("patient_id").cast("string"), "concept_key", "tag")))


def contradiction_members(facts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(patient, concept, tag, fact): the facts each contradiction is about, read in fact-id order."""
    found = contradictions(facts) if found is None else found
    f = _graph_facts(facts).select("patient_id", "concept_key", "fact_id", F.to_date("observed_at").alias("fact_day"))
    return (f.join(found.select("patient_id", "concept_key", "tag", "day"), ["patient_id", "concept_key"])
            .filter(F.col("day").isNull() | (F.col("day") == F.col("fact_day")))
            .select("patient_id", "concept_key", "tag", "fact_id"))
