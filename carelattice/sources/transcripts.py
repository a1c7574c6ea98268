"""Keyword extraction from spoken text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import is_blank

# --- fixed values: pattern, event kind, label, value --------------------------
KEYWORD_RULES = [
    ("tired|fatigue|exhausted", "symptom", "Fatigue", None),
    ("swelling|edema", "symptom", "Swelling", None),
    ("shortness of breath|breathless|sob", "symptom", "Shortness of breath", None),
    ("ibuprofen|advil|motrin|nsaid", "medication", "NSAID use", "Self-reported"),
    ("missed|insurance|appointment", "barrier", "Care access barrier", None),
    ("refill|pharmacy", "barrier", "Medication refill issue", None),
]
FALLBACK_KIND, FALLBACK_LABEL, FALLBACK_LENGTH = "note", "Patient-reported context", 200
# --- end of fixed values ----------------------------------------------------


def rule_hits(flags: list[Column], fallback_text: Column) -> Column:
    """Array of event structs for the rules that fired, else the single fallback note."""
    none = F.lit(None).cast("string")
    rows = [F.when(flag, F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(label).alias("label"),
                                  (F.lit(value) if value else none).alias("value"), F.lit("active").alias("status")))
            for i, (flag, (_, kind, label, value)) in enumerate(zip(flags, KEYWORD_RULES))]
    fired = F.filter(F.array(*rows), lambda r: r.isNotNull())
    fallback = F.array(F.struct(
        F.lit(len(KEYWORD_RULES)).alias("rule"), F.lit(FALLBACK_KIND).alias("kind"), F.lit(FALLBACK_LABEL).alias("label"),
        F.substring(fallback_text, 1, FALLBACK_LENGTH).alias("value"), none.alias("status")))
    return F.when(F.size(fired) > 0, fired).otherwise(fallback)


def transcript_events(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of rows patient_id, source_id, captured_at, text; blank text is rejected."""
    low = F.lower("text")
    ok = transcripts.filter(~is_blank(F.col("text")))
    hits = rule_hits([low.rlike(p) for p, *_ in KEYWORD_RULES], F.col("text"))
    ev = ok.select("patient_id", "source_id", F.col("captured_at").alias("observed_at"), F.inline(hits)).select(
        F.concat_ws("_", F.lit("evt"), "source_id", F.col("rule").cast("string")).alias("event_id"), "patient_id",
        "source_id", F.lit("voice").alias("source_type"), "rule", "kind", "label", "value", "status", "observed_at")
    return ev, transcripts.filter(is_blank(F.col("text"))).withColumn("reason", F.lit("Transcript is required."))
