"""Grounding of free-text labels to lexicon concepts.

Exact aliases are an equi-join with a constant dimension; word containment is a
column expression over a constant phrase list.  Neither moves the events, so a
label that fills a third of all rows costs nothing extra.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import collapse_space, fix_acronyms, title_case
from carelattice.lexicon import Lexicon
from carelattice.session import cut_lineage

CONCEPT_COLUMNS = ["coding_system", "coding_code", "coding_display", "category", "system_group", "ref_unit",
                   "ref_low", "ref_high", "direction", "specialties", "drug_classes", "monitor_labs"]


def concept_kind(kind: Column) -> Column:
    """Concept kind an event kind is restricted to; null means any."""
    return (F.when(kind.isin("condition", "medication", "symptom", "lab"), kind)
            .when(kind == "vital", "lab"))


def contained_concept(text: Column, target: Column, lex: Lexicon) -> Column:
    """Id of the first phrase found in ``text`` as a whole word, in lexicon order.
    Only the first occurrence of a phrase is tested, as in the original behaviour."""
    phrases = lex.phrase_rows()
    doc = json.dumps([dict(key=k, kind=kd, id=i) for _, k, kd, i in phrases])
    table = F.from_json(F.lit(doc), "array<struct<key:string,kind:string,id:int>>")
    words = "|".join(re.escape(k) for _, k, _, _ in phrases)
    # cheap necessary condition, so the ordered scan runs only for labels that can match
    may_match = text.rlike(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])")

    def hit(p: Column) -> Column:
        at = F.instr(text, p["key"])
        before = text.substr(at - 1, F.lit(1))
        after = text.substr(at + F.length(p["key"]), F.lit(1))
        return ((target.isNull() | (p["kind"] == target)) & (at > 0)
                & ((at == 1) | ~before.rlike("^[a-z0-9]$")) & ~after.rlike("^[a-z0-9]$"))

    return F.when(may_match, F.get(F.filter(table, hit), 0)["id"])


def ground(df: DataFrame, lex: Lexicon | None = None, label: str = "label", kind: str = "kind") -> DataFrame:
    """Add concept_id, known, concept_kind, canonical, normalized_label and the concept's attributes."""
    lex = lex or Lexicon.default()
    spark = df.sparkSession
    raw = F.coalesce(F.col(label), F.lit(""))
    out = df.select("*", F.lower(collapse_space(raw)).alias("_text"), concept_kind(F.col(kind)).alias("_target"))
    out = out.join(
        lex.aliases(spark), (F.col("_text") == F.col("alias_key"))
        & (F.col("_target").isNull() | (F.col("alias_kind") == F.col("_target"))), "left")
    out = out.select(*df.columns, "_target", F.coalesce(
        F.col("alias_concept_id"), contained_concept(F.col("_text"), F.col("_target"), lex)).alias("concept_id"))
    known = F.col("concept_id").isNotNull()
    generic = F.when(~known, title_case(raw))
    return out.join(lex.concept_table(spark), "concept_id", "left").select(
        *df.columns, "concept_id", known.alias("known"),
        F.coalesce(F.col("c_kind"), F.col("_target"), F.lit("condition")).alias("concept_kind"),
        F.coalesce(F.col("c_canonical"), generic).alias("canonical"),
        F.coalesce(F.col("c_canonical"), fix_acronyms(generic)).alias("normalized_label"), *CONCEPT_COLUMNS)


def ground_rows(df: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """``ground`` for many rows: each distinct (label, kind) is grounded once and written, rows fetch the result.
    The written table's size decides whether it is broadcast."""
    once = cut_lineage(ground(cut_lineage(df.select("label", "kind").distinct()), lex)).withColumnsRenamed({"label": "_label", "kind": "_kind"})
    return df.join(once, F.col("label").eqNullSafe(F.col("_label")) & F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_label", "_kind")


def canonical_key(kind: Column, normalized: Column) -> Column:
    return F.concat_ws(":", kind, F.lower(normalized))


def specialties_or_default(specialties: Column) -> Column:
    return F.when(F.size(specialties) > 0, specialties).otherwise(F.array(F.lit("primary_care")))
