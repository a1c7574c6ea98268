"""Projection of an activity log (event_id, ts, user_id, event_type, value) to health events.

The log carries no clinical text, so kinds and labels come from a small fixed
vocabulary chosen by event type and id; values scale the numeric column.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.lexicon import local_table

# --- fixed values -----------------------------------------------------------
# kind, slot, label, unit, lowest value, highest value
VOCABULARY = [
    ("lab", 0, "HbA1c", "%", 5.0, 9.0), ("lab", 1, "eGFR", "mL/min", 30.0, 100.0),
    ("lab", 2, "serum potassium", "mEq/L", 3.0, 6.0), ("lab", 3, "a1c", "%", 5.0, 9.0),
    ("lab", 4, "TSH", "mIU/L", 0.2, 9.5), ("lab", 5, "Ferritin", "ng/mL", 10.0, 300.0),
    ("vital", 0, "Blood pressure", "mmHg", 100.0, 170.0), ("vital", 1, "Weight", "lb", 120.0, 220.0),
    ("vital", 2, "bp", "mmHg", 100.0, 170.0),
    ("medication", 0, "Advil", None, None, None), ("medication", 1, "ibuprofen 400mg", None, None, None),
    ("medication", 2, "Warfarin", None, None, None), ("medication", 3, "Lisinopril", None, None, None),
    ("medication", 4, "Spironolactone", None, None, None), ("medication", 5, "Metformin", None, None, None),
    ("condition", 0, "CKD", None, None, None), ("condition", 1, "Chronic kidney disease", None, None, None),
    ("condition", 2, "Type 2 diabetes", None, None, None), ("condition", 3, "history of HTN", None, None, None),
    ("condition", 4, "Fibromyalgia syndrome", None, None, None),
    ("condition", 5, "Fibromyalgia syndromes", None, None, None),
    ("symptom", 0, "tired", None, None, None), ("symptom", 1, "swelling", None, None, None),
    ("symptom", 2, "Shortness of breath", None, None, None), ("symptom", 3, "dizzy", None, None, None),
    ("barrier", 0, "Missed appointment", None, None, None), ("barrier", 1, "Lisinopril refill issue", None, None, None),
    ("care_task", 0, "Repeat HbA1c", None, None, None), ("note", 0, "Patient-reported context", None, None, None),
]
# --- end of fixed values ----------------------------------------------------


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, seq, patient_id, source_id, source_type, kind, label, unit, value, observed_at, status."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    by_kind: dict[str, list[tuple]] = {}
    for kind, _, *entry in VOCABULARY:
        by_kind.setdefault(kind, []).append(tuple(entry))
    vocab = local_table(spark, [(kind, i, *e) for kind, entries in by_kind.items() for i, e in enumerate(entries)], pa.schema([
        ("kind", pa.string()), ("slot", pa.int32()), ("label", pa.string()), ("unit", pa.string()), ("lo", pa.float64()), ("hi", pa.float64())]))
    size = F
    for kind, entries in by_kind.items():
        size = size.when(F.col("kind") == kind, F.lit(len(entries)))
    eid = F.col("event_id")
    kind = (F.when(eid % 41 == 0, "note").when(eid % 37 == 0, "care_task").when(eid % 29 == 0, "barrier")
            .when(F.col("event_type") == "click", "medication").when(F.col("event_type") == "purchase", "lab")
            .when(F.col("event_type") == "error", "condition").when(F.col("event_type") == "signup", "symptom")
            .otherwise("vital"))
    # an event without a slot, such as one without an id, keeps its kind alone
    typed = log.withColumn("kind", kind).withColumn("slot", (eid % size).cast("int")).join(vocab, ["kind", "slot"], "left")
    source_no = eid % 7 % 3
    scaled = F.col("lo") + F.col("value") / 500.0 * (F.col("hi") - F.col("lo"))
    value = (F.when(F.col("lo").isNull(), None)
             .when(F.col("unit") == "mmHg", F.concat(
                 F.floor(scaled).cast("int").cast("string"), F.lit("/"),
                 F.floor(60 + F.col("value") / 500.0 * 45).cast("int").cast("string")))
             .otherwise(F.concat(F.floor(scaled).cast("int").cast("string"), F.lit("."),
                                 (F.floor(scaled * 10).cast("bigint") % 10).cast("string"))))
    return (typed
            .select(F.concat(F.lit("evt_"), eid).alias("event_id"), eid.alias("seq"),
                    F.col("user_id").alias("patient_id"),
                    F.concat(F.lit("src_"), F.col("user_id"), F.lit("_"), source_no).alias("source_id"),
                    F.when(source_no == 0, "emr").when(source_no == 1, "voice").otherwise("doctor_note")
                    .alias("source_type"),
                    "kind", "label", "unit", value.alias("value"), F.col("ts").cast("timestamp").alias("observed_at"),
                    F.when(F.col("kind").isin("condition", "medication"),
                           F.when(eid % 11 == 0, "resolved").otherwise("active")).alias("status")))


def health_sources(events: DataFrame) -> DataFrame:
    """One source row per (patient, source): type, title, capture time, raw text of spoken sources."""
    name = (F.when(F.col("source_type") == "emr", "EMR import")
            .when(F.col("source_type") == "voice", "Voice note").otherwise("Doctor note"))
    return (events.groupBy("patient_id", "source_id", "source_type")
            .agg(F.min("observed_at").alias("captured_at"))
            .withColumn("title", F.concat(name, F.lit(" "), F.col("source_id")))
            .withColumn("raw_text", F.when(F.col("source_type") == "voice", F.concat(
                F.lit("Patient "), F.col("patient_id").cast("string"), F.lit(" describes symptoms and medications.")))))
