"""Events to candidate facts to validated, deduplicated, corroborated clinical facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import JS_SPACE, is_blank, stable_id
from carelattice.functions.values import CONFIDENCE_REJECT, confidence, lab_flag, review_status
from carelattice.lexicon import Lexicon
from carelattice.operators.grounding import CONCEPT_COLUMNS, ground_rows
from carelattice.session import cut_lineage

# --- fixed values -----------------------------------------------------------
GRAPH_KINDS = ("condition", "symptom", "medication", "lab", "vital", "care_task", "barrier")
GENERIC_LABELS = ("patient-reported context", "clinician note", "noted labs", "medication plan update")
QUOTE_LENGTH = 240
# --- end of fixed values ----------------------------------------------------

# a trimmed generic label; anchored, so that other labels fail at once
_GENERIC = rf"^[{JS_SPACE}]*(?:{'|'.join(re.escape(x) for x in GENERIC_LABELS)})[{JS_SPACE}]*\z"

OPTIONAL = {
    "value": "string", "value_is_num": "boolean", "unit": "string", "status": "string", "source_type": "string",
    "ai_extracted": "boolean", "ai_score": "double", "ai_confidence": "double", "uncertain": "boolean",
    "negated": "boolean", "model": "string", "prompt_version": "string", "observed_text": "string",
}


def with_optional(df: DataFrame) -> DataFrame:
    """Fill in the optional event columns a feed may lack."""
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in OPTIONAL.items() if name not in df.columns]
    return df.select("*", *missing)


def relevance(kind: Column, label: Column) -> Column:
    return (F.when(is_blank(label), "ignore")
            .when(F.lower(label).rlike(_GENERIC), "evidence_only")
            .when(kind.isin("note", "encounter"), "evidence_only")
            .when(kind.isin(*GRAPH_KINDS), "graph").otherwise("evidence_only"))


def evidence_quote(value: Column, value_is_num: Column, raw_text: Column) -> Column:
    is_text = ~F.coalesce(value_is_num, F.lit(False))
    return F.when(is_text & (F.length(value) > 12), value).otherwise(F.substring(raw_text, 1, QUOTE_LENGTH))


def attach_sources(events: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Left join to the source rows.  Without sources the events' own source_type is used."""
    events = with_optional(events)
    none = F.lit(None).cast("string")
    if sources is None:
        return events.select("*", none.alias("source_title"), none.alias("raw_text"))
    s = sources.select("patient_id", "source_id", "source_type", F.col("title").alias("source_title"),
                       F.substring("raw_text", 1, QUOTE_LENGTH).alias("raw_text"))
    return events.drop("source_type").join(s, ["patient_id", "source_id"], "left")


def candidate_facts(events: DataFrame, sources: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """Normalised, grounded and scored candidates; one row per event."""
    c = attach_sources(ground_rows(events, lex), sources)
    ai = F.coalesce("ai_extracted", F.lit(False))
    score = F.coalesce(F.col("ai_score"), F.when(ai, F.col("ai_confidence")))
    c = c.withColumns({
        "ai_extracted": ai, "ai_score": score, "uncertain": F.coalesce("uncertain", F.lit(False)),
        "negated": F.coalesce("negated", F.lit(False)),
        "evidence_quote": evidence_quote(F.col("value"), F.col("value_is_num"), F.col("raw_text")),
        "unit": F.coalesce("unit", "ref_unit"), "relevance": relevance(F.col("kind"), F.col("label")),
        "lab_flag": F.when(F.col("concept_kind") == "lab", lab_flag(
            F.col("concept_kind"), F.col("ref_low"), F.col("ref_high"), F.col("value")))})
    return c.withColumn("confidence", _score(F.lit(1))).drop("raw_text")


def _score(sources: Column) -> Column:
    return confidence(F.col("source_type"), F.col("ai_extracted"), F.col("ai_score"), F.col("known"),
                      ~is_blank(F.col("evidence_quote")), F.col("coding_code").isNotNull(), F.col("uncertain"),
                      sources)


def candidate_id(df: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("event_id"), F.col("source_id"), F.col("kind"), F.col("label"))
    return df.withColumn("candidate_id", stable_id("cand", key))


def validate(candidates: DataFrame) -> DataFrame:
    """accepted flag and the reason: the first failing check, else a review note or null."""
    bad_date = F.col("observed_at").isNull()
    reject = (F.when(is_blank(F.col("label")), "Empty label")
              .when(F.col("relevance") == "ignore", "Marked irrelevant")
              .when(F.col("negated"), "Negated fact")
              .when(F.col("confidence") < CONFIDENCE_REJECT, "Low extraction confidence")
              .when(bad_date, "Invalid observed date"))
    status = review_status(F.col("confidence"), F.col("uncertain"))
    return candidates.withColumns({
        "accepted": reject.isNull(), "review_status": status,
        "review_reason": F.coalesce(reject, F.when(
            status == "needs_review", "Needs review due to uncertainty or medium confidence"))})


def review_items(validated: DataFrame) -> DataFrame:
    """Review rows of single facts: rejected candidates and accepted ones that need a look."""
    v = candidate_id(validated.filter(F.col("review_reason").isNotNull()))
    target = F.when(F.col("accepted"), F.col("event_id")).otherwise(F.col("candidate_id"))
    return v.select("patient_id", F.lit("fact").alias("target_type"), target.alias("target_id"),
                    F.col("review_reason").alias("reason"), F.lit("open").alias("status"),
                    stable_id("review", F.concat_ws(":", target, F.col("review_reason"))).alias("review_id"))


def first_wins(df: DataFrame, keys: list[Column | str], order: Column | str = "seq") -> DataFrame:
    """First row per key in ``order``.  An aggregate, so copies collapse before the shuffle
    even when one key holds a large share of the rows."""
    cols = df.columns
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), order if isinstance(order, Column) else F.col(order))
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*").select(*cols)


def fact_fingerprint() -> list[Column]:
    return [F.col("patient_id").alias("_k0"), F.col("source_id").alias("_k1"), F.col("kind").alias("_k2"),
            F.col("normalized_label").alias("_k3"), F.col("observed_at").alias("_k4"),
            F.coalesce("value", F.lit("")).alias("_k5")]


def with_validity(df: DataFrame, recorded_at: Column) -> DataFrame:
    """Valid time opens at the observation and closes when the fact is reported resolved."""
    def keep(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.withColumns({
        "recorded_at": keep("recorded_at", recorded_at), "valid_from": keep("valid_from", F.col("observed_at")),
        "valid_to": keep("valid_to", F.when(F.col("status") == "resolved", F.col("observed_at")))})


def source_counts(facts: DataFrame) -> DataFrame:
    """Distinct sources per (patient, kind, label): two-phase distinct aggregation, no hot task."""
    return (facts.groupBy("patient_id", "kind", F.lower("normalized_label").alias("label_key"))
            .agg(F.count_distinct("source_id").alias("source_count")))


def corroborate(facts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rescore by the number of agreeing sources; status is re-derived only where the score moved."""
    counts = source_counts(facts) if counts is None else counts
    j = facts.withColumn("label_key", F.lower("normalized_label")).join(
        counts, ["patient_id", "kind", "label_key"], "left").drop("label_key")
    j = j.withColumn("source_count", F.coalesce("source_count", F.lit(1)))
    j = j.withColumn("_new", _score(F.col("source_count")))
    status = F.when(F.col("_new") == F.col("confidence"), F.col("review_status")) \
              .otherwise(review_status(F.col("_new"), F.col("uncertain")))
    return j.withColumns({"review_status": status, "confidence": F.col("_new")}).drop("_new")


def attach_first_chunk(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    first = chunks.filter(F.col("ordinal") == 0).select(
        "patient_id", "source_id", "chunk_id", F.col("start_offset").alias("chunk_start"),
        F.col("end_offset").alias("chunk_end"))
    return facts.join(first, ["patient_id", "source_id"], "left")


def with_provenance(facts: DataFrame) -> DataFrame:
    def opt(name: str, kind: str) -> Column:
        return F.col(name) if name in facts.columns else F.lit(None).cast(kind)

    return facts.withColumn("provenance", F.struct(
        F.col("source_id"), opt("chunk_id", "string").alias("chunk_id"), F.col("evidence_quote").alias("quote"),
        opt("chunk_start", "int").alias("start_offset"), opt("chunk_end", "int").alias("end_offset"),
        F.when(F.col("ai_extracted"), "ai").otherwise("rules").alias("method"), F.col("model"),
        F.col("prompt_version")))


def fact_core(events: DataFrame, sources: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """Validated, deduplicated and rescored facts without what ``complete_facts`` derives from a row alone.  Source counts are
    taken before deduplication (removing copies of a fact never removes a source), so that branch reads only the label columns."""
    accepted = validate(candidate_facts(events, sources, lex)).filter("accepted")
    # the concept's attributes stay behind while facts are shuffled and return by a constant-size join
    accepted = cut_lineage(accepted.drop(*CONCEPT_COLUMNS, "accepted"))  # grounded once, read by both branches
    narrow = first_wins(accepted, fact_fingerprint())
    attributes = (lex or Lexicon.default()).concept_table(events.sparkSession).select("concept_id", "coding_code")
    return corroborate(narrow.join(attributes, "concept_id", "left"), source_counts(accepted)).drop("coding_code")


def complete_facts(core: DataFrame, recorded_at: Column | None = None, chunks: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """Concept attributes, validity, ids and provenance of ``fact_core`` rows.  Nothing but chunks is shuffled for them, so a store need not hold them."""
    attributes = (lex or Lexicon.default()).concept_table(core.sparkSession).select("concept_id", *CONCEPT_COLUMNS)
    facts = core.join(attributes, "concept_id", "left")
    facts = with_validity(facts, recorded_at if recorded_at is not None else F.lit(None).cast("timestamp"))
    if chunks is not None:
        facts = attach_first_chunk(facts, chunks)
    return with_provenance(facts.withColumn("fact_id", F.col("event_id")))


def clinical_facts(events: DataFrame, sources: DataFrame | None = None, recorded_at: Column | None = None,
                   chunks: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """The whole cascade."""
    return complete_facts(fact_core(events, sources, lex), recorded_at, chunks, lex)


def events_from_facts(facts: DataFrame) -> DataFrame:
    """Facts projected back as events, for stores that keep only facts."""
    label = F.when(F.coalesce(F.col("normalized_label"), F.lit("")) != "", F.col("normalized_label")) \
             .otherwise(F.col("label"))
    return facts.select("event_id", "patient_id", "seq", "source_id", "source_type", "kind", label.alias("label"),
                        "value", "unit", "observed_at", "status", "fact_id", "confidence", "ai_extracted", "ai_score",
                        "relevance", "review_status", "evidence_quote")


def review_totals(*items: DataFrame) -> DataFrame:
    """(patient_id, target_type, open_items) over any review rows."""
    every = items[0].select("patient_id", "target_type", "status")
    for more in items[1:]:
        every = every.unionByName(more.select("patient_id", "target_type", "status"))
    return every.filter(F.col("status") == "open").groupBy("patient_id", "target_type").agg(F.count(F.lit(1)).alias("open_items"))
