"""Clinician notes: labelled text to fields, fields to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_trim

# --- fixed values -----------------------------------------------------------
FIELD_PATTERNS = {"follow_up": r"(?m)^Follow-up: (.+)$", "lab": r"(?m)^Labs: (.+)$",
                  "medication_change": r"(?m)^Medication: (.+)$"}
CLINICIAN_PATTERN = r"(?m)^Clinician: (.+)$"
CLINICIAN_PARTS = r"^(.+?) \((.+)\)$"
NOTE_PATTERN = r"(?m)^Note: ([\s\S]+?)(?:\n(?:Follow-up|Labs|Medication):|$)"
MIN_NOTE_LENGTH = 10
# --- end of fixed values ----------------------------------------------------


def split_note(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds clinician, specialty, note, follow_up, lab, medication_change read from labelled lines."""
    t = F.col(text)
    line = F.regexp_extract(t, CLINICIAN_PATTERN, 1)

    def or_default(c: Column, default: str) -> Column:
        trimmed = js_trim(c)
        return F.when(trimmed != "", trimmed).otherwise(default)

    cols = {
        "clinician": or_default(F.regexp_extract(line, CLINICIAN_PARTS, 1), "Clinician"),
        "specialty": or_default(F.regexp_extract(line, CLINICIAN_PARTS, 2), "Unknown"),
        "note": F.when(t.rlike(NOTE_PATTERN), js_trim(F.regexp_extract(t, NOTE_PATTERN, 1))).otherwise(t)}
    for name, pattern in FIELD_PATTERNS.items():
        cols[name] = F.when(t.rlike(pattern), js_trim(F.regexp_extract(t, pattern, 1)))
    return df.withColumns(cols)


def note_text() -> Column:
    """Inverse of ``split_note``."""
    def opt(label: str, name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(label), F.col(name)))

    return F.concat_ws("\n", F.concat(F.lit("Clinician: "), "clinician", F.lit(" ("), "specialty", F.lit(")")),
                       F.concat(F.lit("Note: "), "note"), opt("Follow-up: ", "follow_up"), opt("Labs: ", "lab"),
                       opt("Medication: ", "medication_change"))


def gate_notes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): clinician and note must not be blank."""
    ok = (F.coalesce(js_trim(F.col("clinician")), F.lit("")) != "") & (F.coalesce(js_trim(F.col("note")), F.lit("")) != "")
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit("Clinician name and note are required."))


def gate_spoken(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): spoken notes need at least ten characters after trimming."""
    ok = F.coalesce(F.length(js_trim(F.col(text))) >= MIN_NOTE_LENGTH, F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit("Note is too short."))


def note_events(notes: DataFrame) -> DataFrame:
    """Events of each note (patient_id, source_id, captured_at and the split fields): always a note and
    an encounter, then what the optional fields and the wording add."""
    low = F.lower("note")
    none = F.lit(None).cast("string")

    def has(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    def row(when: Column, kind: str, label: Column | str, value: Column | str | None = None, status: str | None = None):
        as_col = lambda x: none if x is None else (F.lit(x) if isinstance(x, str) else x)
        return F.when(when, F.struct(F.lit(kind).alias("kind"), as_col(label).alias("label"), as_col(value).alias("value"),
                                     as_col(status).alias("status")))

    # --- fixed values: labels, values and trigger words of the extraction rules
    rows = [
        row(F.lit(True), "note", "Clinician note", F.col("note")),
        row(F.lit(True), "encounter", F.concat("specialty", F.lit(" documentation"))),
        row(has("follow_up"), "care_task", F.col("follow_up"), None, "pending"),
        row(has("lab"), "lab", "Noted labs", F.col("lab")),
        row(has("medication_change"), "medication", "Medication plan update", F.col("medication_change"), "active"),
        row(low.contains("ibuprofen"), "medication", "Ibuprofen", "Recommended by urgent care for knee pain", "active"),
        row(low.contains("cardiology"), "care_task", "Cardiology visit scheduled", None, "pending"),
        row(low.contains("bmp") | low.contains("egfr") | low.contains("potassium"), "care_task", "Repeat BMP ordered",
            "Due to elevated potassium and reduced eGFR", "pending"),
    ]
    # --- end of fixed values
    fired = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return notes.select("patient_id", "source_id", F.col("captured_at").alias("observed_at"), "clinician", "specialty",
                        F.posexplode(fired).alias("pos", "r")).select(
        F.concat_ws("_", F.lit("evt"), "source_id", F.col("pos").cast("string")).alias("event_id"), "patient_id",
        "source_id", F.lit("doctor_note").alias("source_type"), "pos", "r.kind", "r.label", "r.value", "r.status",
        "observed_at", F.when(F.col("pos") < 2, F.col("clinician")).alias("clinician"),
        F.when(F.col("pos") < 2, F.col("specialty")).alias("specialty"))
