"""Facts and events proposed by an external extractor, loaded from its JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import is_blank, js_number, js_trim, stable_id, strip_code_fence
from carelattice.lexicon import EVENT_KINDS, Lexicon
from carelattice.operators.facts import _score, validate, with_provenance
from carelattice.operators.grounding import ground

FACTS_SCHEMA = ("struct<facts:array<struct<kind:string,label:string,normalizedLabel:string,value:variant,unit:string,"
                "observedAt:string,status:string,relevance:string,confidence:double,evidenceQuote:string,"
                "negated:boolean,uncertain:boolean>>>")
EVENTS_SCHEMA = "struct<events:array<struct<type:string,label:string,value:variant,unit:string,status:string>>>"

# --- fixed values -----------------------------------------------------------
STATUSES = ("active", "resolved", "unknown")
RELEVANCES = ("graph", "evidence_only", "ignore")
DEFAULT_SCORE = 0.65
# --- end of fixed values ----------------------------------------------------


def json_payload(raw: Column) -> Column:
    return strip_code_fence(raw)


def variant_text(v: Column) -> Column:
    is_num = ~F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID", "BOOLEAN"), F.lit(True))
    return F.when(is_num, js_number(F.try_variant_get(v, "$", "double"))).otherwise(F.try_variant_get(v, "$", "string"))


def _known_status(c: Column) -> Column:
    return F.when(c.isin(*STATUSES), c).otherwise("active")


def extracted_candidates(payloads: DataFrame, run_ts: Column, lex: Lexicon | None = None) -> DataFrame:
    """Candidates of rows patient_id, source_id, source_type, raw.  Rows without a label or with an unknown
    kind are skipped; every other field falls back to its default."""
    parsed = payloads.select("patient_id", "source_id", "source_type",
                             F.posexplode(F.from_json(json_payload(F.col("raw")), FACTS_SCHEMA)["facts"]).alias("pos", "f"))
    f = parsed.filter((F.coalesce(F.col("f.label"), F.lit("")) != "") & F.col("f.kind").isin(*EVENT_KINDS))
    proposed = F.when(~is_blank(F.col("f.normalizedLabel")), F.col("f.normalizedLabel")).otherwise(F.col("f.label"))
    none = F.lit(None).cast("string")
    # labels are normalised without a kind restriction, then grounded under the proposed kind
    f = ground(f.select("*", proposed.alias("_proposed"), none.alias("_any")), lex, "_proposed", "_any").select(
        "patient_id", "source_id", "source_type", "pos", "f", F.col("normalized_label").alias("_norm"))
    f = f.select("*", F.col("f.kind").alias("kind"))
    g = ground(f, lex, "_norm", "kind").withColumn("normalized_label", F.col("_norm"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("f.confidence"), F.lit(DEFAULT_SCORE))))
    quote = js_trim(F.col("f.evidenceQuote"))
    c = g.withColumns({
        "label": F.col("f.label"), "value": variant_text(F.col("f.value")), "unit": F.col("f.unit"),
        "observed_at": F.coalesce(F.try_to_timestamp(F.col("f.observedAt")), run_ts),
        "status": _known_status(F.col("f.status")),
        "relevance": F.when(F.col("f.relevance").isin(*RELEVANCES), F.col("f.relevance")).otherwise("evidence_only"),
        "ai_extracted": F.lit(True), "ai_score": score, "evidence_quote": quote,
        "negated": F.coalesce(F.col("f.negated"), F.lit(False)),
        "uncertain": F.coalesce(F.col("f.uncertain"), F.lit(False)), "model": none, "prompt_version": none})
    return c.withColumn("confidence", _score(F.lit(1))).drop("f", "_norm")


def accepted_events(candidates: DataFrame) -> DataFrame:
    """Accepted, non-ignored candidates as events with an id derived from their content."""
    v = validate(candidates).filter("accepted").filter(F.col("relevance") != "ignore")
    key = F.concat_ws(":", "source_id", "kind", "normalized_label",
                      F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.coalesce("value", F.lit("")))
    return with_provenance(v).select(
        stable_id("evt", key).alias("event_id"), "patient_id", "source_id", "source_type", "pos", "kind",
        F.col("normalized_label").alias("label"), "value", "unit", "observed_at", "status", "relevance", "confidence",
        "ai_score", "review_status", "evidence_quote", "provenance")


def parsed_events(payloads: DataFrame, run_ts: Column) -> DataFrame:
    """Events of a parsed conversation: label and known type required, status defaults to active."""
    e = payloads.select("patient_id", "source_id",
                        F.posexplode(F.from_json(json_payload(F.col("raw")), EVENTS_SCHEMA)["events"]).alias("pos", "e"))
    e = e.filter((F.coalesce(F.col("e.label"), F.lit("")) != "") & F.col("e.type").isin(*EVENT_KINDS))
    return e.select(F.concat_ws("_", F.lit("evt"), "source_id", F.col("pos").cast("string")).alias("event_id"),
                    "patient_id", "source_id", "pos", F.col("e.type").alias("kind"), F.col("e.label").alias("label"),
                    variant_text(F.col("e.value")).alias("value"), F.col("e.unit").alias("unit"),
                    _known_status(F.col("e.status")).alias("status"), run_ts.alias("observed_at"))
