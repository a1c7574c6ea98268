"""Numeric readings, reference ranges and confidence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelattice.functions.text import js_round

# --- fixed values -----------------------------------------------------------
CONFIDENCE_REJECT = 0.45
CONFIDENCE_REVIEW = 0.75
SOURCE_BASE = {"emr": 0.9, "doctor_note": 0.85, "voice": 0.8, "manual": 0.82}
DEFAULT_BASE = 0.8
# --- end of fixed values ----------------------------------------------------

_BP = r"([0-9]{2,3})\s*/\s*([0-9]{2,3})"


def parse_number(value: Column) -> Column:
    """First signed decimal in the text, else null."""
    return F.nullif(F.regexp_extract(value, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def systolic(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, _BP, 1), F.lit("")).cast("double")


def diastolic(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, _BP, 2), F.lit("")).cast("double")


def reading(value: Column) -> Column:
    """Systolic pressure if the text is ``sys/dia``, else its first number."""
    return F.coalesce(systolic(value), parse_number(value))


def strict_number(value: Column) -> Column:
    """The whole text as a number; ``120/80`` and free text give null."""
    return value.try_cast("double")


def lab_flag(kind: Column, low: Column, high: Column, value: Column) -> Column:
    x = parse_number(value)
    return (F.when(F.coalesce(kind != "lab", F.lit(True)) | x.isNull(), "unknown")
            .when(high.isNotNull() & (x > high), "high")
            .when(low.isNotNull() & (x < low), "low")
            .when(low.isNull() & high.isNull(), "unknown")
            .otherwise("normal"))


def is_concerning(direction: Column, flag: Column) -> Column:
    return F.coalesce(
        F.when(flag.isin("normal", "unknown"), F.lit(False))
        .when(direction == "two_sided", F.lit(True))
        .when(direction == "higher_worse", flag == "high")
        .when(direction == "lower_worse", flag == "low"), F.lit(False))


def tolerance(first: Column) -> Column:
    return F.greatest(F.lit(0.01), F.abs(first) * 0.02)


def drift(first: Column, last: Column) -> Column:
    delta = last - first
    return (F.when(delta > tolerance(first), "rising")
            .when(delta < -tolerance(first), "falling").otherwise("stable"))


def is_worsening(direction: Column, moved: Column) -> Column:
    return (F.when(moved == "stable", F.lit(False))
            .when(direction == "higher_worse", moved == "rising")
            .when(direction == "lower_worse", moved == "falling")
            .otherwise(F.lit(True)))


def base_confidence(source_type: Column, ai: Column, ai_score: Column) -> Column:
    by_type = F.when(F.lit(False), F.lit(DEFAULT_BASE))
    for name, score in SOURCE_BASE.items():
        by_type = by_type.when(source_type == name, F.lit(score))
    return F.when(ai, F.greatest(F.lit(0.5), F.least(F.lit(0.88), F.coalesce(ai_score, F.lit(0.65)) * 0.92))) \
            .otherwise(by_type.otherwise(F.lit(DEFAULT_BASE)))


def confidence(source_type: Column, ai: Column, ai_score: Column, grounded: Column, has_quote: Column,
               has_coding: Column, uncertain: Column, sources: Column) -> Column:
    def plus(flag: Column, amount: float) -> Column:
        return F.when(flag, F.lit(amount)).otherwise(F.lit(0.0))

    score = base_confidence(source_type, ai, ai_score)
    # additions stay in one fixed order: floating point sums are order-sensitive
    score = score + plus(grounded, 0.08)
    score = score + plus(has_quote, 0.05)
    score = score + plus(has_coding, 0.05)
    score = score + plus(sources >= 2, 0.1)
    score = score + plus(sources >= 3, 0.05)
    score = score - plus(uncertain, 0.15)
    score = score - plus(~grounded & ai, 0.08)
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def review_status(score: Column, uncertain: Column) -> Column:
    return F.when((score < CONFIDENCE_REVIEW) | uncertain, "needs_review").otherwise("accepted")
