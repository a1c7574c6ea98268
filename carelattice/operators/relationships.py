"""Relationship inference between the entities of a patient.

Rules are rows.  All concept-to-concept families share one rule table, so inference is
one broadcast of constant rules and one join of entities on (patient, concept); a
patient has at most one entity per known concept, so the join never fans out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_number, similarity, stable_id
from carelattice.functions.values import CONFIDENCE_REVIEW
from carelattice.lexicon import SEVERITY_CONFIDENCE, Lexicon, local_table
from carelattice.session import cut_lineage

# --- fixed values -----------------------------------------------------------
RISK_CONFIDENCE, TREND_CONFIDENCE, SYMPTOM_CONFIDENCE, BARRIER_CONFIDENCE = 0.72, 0.8, 0.6, 0.65
BARRIER_THRESHOLD = 0.3
# --- end of fixed values ----------------------------------------------------


def _empty() -> Column:
    return F.lit(None).cast("string")


# The texts of this function must read as they do.
def pair_rules(lex: Lexicon, spark) -> DataFrame:
    """(family, rule_no, from_concept, to_concept, relation, confidence, severity, rationale, in_order)."""
    rows = []
    concepts = lex.concepts
    for r in lex.contraindications:
        for m in concepts:
            for c in concepts:
                if (m["kind"] == "medication" and r["drug_class"] in m["drug_classes"] and c["kind"] == "condition"
                        and ((r["canonical"] and c["canonical"] == r["canonical"])
                             or (r["category"] and c["category"] == r["category"]))):
                    rows.append((1, r["rule_no"], m["concept_id"], c["concept_id"], "contraindicated_with",
                                 SEVERITY_CONFIDENCE[r["severity"]], r["severity"], r["rationale"], False))
    meds = [c for c in concepts if c["kind"] == "medication"]
    for r in lex.interactions:
        for a in meds:
            for b in meds:
                if ((r["class_a"] in a["drug_classes"] and r["class_b"] in b["drug_classes"])
                        or (r["class_b"] in a["drug_classes"] and r["class_a"] in b["drug_classes"])):
                    rows.append((2, r["rule_no"], a["concept_id"], b["concept_id"], "contraindicated_with",
                                 SEVERITY_CONFIDENCE[r["severity"]], r["severity"], r["rationale"], True))
    conditions = {c["canonical"]: c["concept_id"] for c in concepts if c["kind"] == "condition"}
    for i, (a, b) in enumerate(lex.risk_links):
        rows.append((3, i, conditions[a], conditions[b], "risk_factor_for", RISK_CONFIDENCE, None,
                     f"{a} is a recognized risk factor for {b}.", False))
    linked = set()
    labs = {c["canonical"]: c["concept_id"] for c in concepts if c["kind"] == "lab"}
    for lab, canonical, category in lex.lab_links:
        if lab in linked:
            continue
        linked.add(lab)
        for c in concepts:
            if c["kind"] == "condition" and ((canonical and c["canonical"] == canonical)
                                             or (category and c["category"] == category)):
                rows.append((4, 0, labs[lab], c["concept_id"], "worsening_trend", TREND_CONFIDENCE, None, None, False))
    for a in concepts:
        for b in concepts:
            if (a["kind"] == b["kind"] == "symptom" and a is not b and a["system_group"]
                    and a["system_group"] != "other" and a["system_group"] == b["system_group"]):
                rows.append((5, 0, a["concept_id"], b["concept_id"], "possibly_related_to", SYMPTOM_CONFIDENCE, None,
                             f"{a['canonical']} and {b['canonical']} are both {a['system_group']} symptoms "
                             "and may share a cause.", True))
    return local_table(spark, rows, pa.schema([
        ("family", pa.int32()), ("rule_no", pa.int32()), ("from_concept", pa.int32()), ("to_concept", pa.int32()),
        ("relation", pa.string()), ("confidence", pa.float64()), ("severity", pa.string()), ("rationale", pa.string()),
        ("in_order", pa.bool_())]))


def _side(entities: DataFrame, side: str) -> DataFrame:
    return entities.select(
        "patient_id", F.col("concept_id").alias(f"{side}_concept"), F.col("entity_key").alias(f"{side}_key"),
        F.col("kind").alias(f"{side}_kind"), F.col("canonical_label").alias(f"{side}_label"),
        F.col("first_seq").alias(f"{side}_seq"), F.col("review_status").alias(f"{side}_review"))


def _finish(candidates: DataFrame, lex: Lexicon) -> DataFrame:
    """Domain/range check, then the first candidate per choice key."""
    allowed = lex.relation_table(candidates.sparkSession).select("relation", "from_kind", "to_kind")
    ok = candidates.filter(F.col("from_key") != F.col("to_key")).join(
        allowed, ["relation", "from_kind", "to_kind"], "left_semi")
    review = F.when((F.col("confidence") < CONFIDENCE_REVIEW) | (F.col("from_review") == "needs_review")
                    | (F.col("to_review") == "needs_review"), "needs_review").otherwise("accepted")
    return ok.select("patient_id", "family", "from_key", "to_key", "from_kind", "to_kind", "from_label", "to_label",
                     "relation", "confidence", "severity", "rationale", review.alias("review_status"),
                     "from_seq", "to_seq", "rule_no")


def rule_relationships(entities: DataFrame, trends: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """Families 1-5: contraindications, interactions, risk factors, worsening labs, symptom clusters."""
    lex = lex or Lexicon.default()
    known = entities.filter(F.col("concept_id").isNotNull())
    source = _side(known, "from")
    if trends is not None:
        t = trends.filter("worsening").select(
            "patient_id", F.concat(F.lit("lab:"), "series_key").alias("from_key"), F.lit(True).alias("_worse"),
            F.concat(F.col("label"), F.lit(" is trending "), F.col("direction"), F.lit(" ("),
                     js_number(F.col("first_value")), F.lit("→"), js_number(F.col("last_value")),
                     F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(""),
                     F.lit("), consistent with worsening ")).alias("_story"))
        source = source.join(t, ["patient_id", "from_key"], "left")
    else:
        source = source.withColumn("_worse", F.lit(None).cast("boolean")).withColumn("_story", _empty())
    c = (source.join(F.broadcast(pair_rules(lex, entities.sparkSession)), "from_concept")
         .filter((F.col("family") != 4) | F.coalesce("_worse", F.lit(False)))
         .join(_side(known, "to"), ["patient_id", "to_concept"])
         .filter(~F.col("in_order") | (F.col("from_seq") < F.col("to_seq")))
         .withColumn("rationale", F.when(F.col("family") == 4, F.concat("_story", "to_label", F.lit(".")))
                     .otherwise(F.col("rationale"))))
    c = _finish(c, lex)
    # a worsening lab points at the earliest matching condition, a symptom hangs on the
    # earliest of its organ system; other families keep the first rule per pair
    choice = (F.when(F.col("family") == 4, F.concat_ws("|", F.lit("4"), "from_key"))
              .when(F.col("family") == 5, F.concat_ws("|", F.lit("5"), "to_key"))
              .otherwise(F.concat_ws("|", "from_key", "to_key", "relation")))
    order = F.struct(F.when(F.col("family") == 5, F.col("from_seq")).otherwise(F.col("to_seq")), F.col("family"),
                     F.col("rule_no"))
    cols = c.columns
    return (c.groupBy("patient_id", choice.alias("_choice"))
            .agg(F.min_by(F.struct(*cols), order).alias("_r")).select("_r.*"))


# The texts of this function must read as they do.
def barrier_relationships(entities: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Family 6: each barrier is tied to its lexically closest condition, medication or lab."""
    lex = lex or Lexicon.default()
    barriers = entities.filter(F.col("kind") == "barrier")
    targets = entities.filter(F.col("kind").isin("condition", "medication", "lab"))
    # a patient's few barriers meet their entities directly: at so low a threshold signatures would be most of the bigrams
    met = _side(barriers, "from").join(_side(targets, "to"), ["patient_id"])
    # the distinct pairs are written, since Spark moves the filter below the distinct and would score every patient's pairs
    near = cut_lineage(met.select("from_label", "to_label").distinct()).withColumn("score", similarity(F.col("from_label"), F.col("to_label")))
    kind_rank = F.when(F.col("to_kind") == "condition", 0).when(F.col("to_kind") == "medication", 1).otherwise(2)
    c = (met.join(near.filter(F.col("score") >= BARRIER_THRESHOLD), ["from_label", "to_label"])
         .withColumn("family", F.lit(6)).withColumn("rule_no", F.lit(0)).withColumn("relation", F.lit("barrier_to"))
         .withColumn("confidence", F.lit(BARRIER_CONFIDENCE)).withColumn("severity", _empty())
         .withColumn("rationale", F.concat(F.lit('"'), "from_label", F.lit('" may be obstructing care for '),
                                           "to_label", F.lit("."))))
    cols = c.columns
    best = (c.groupBy("patient_id", "from_key")
            .agg(F.min_by(F.struct(*[F.col(x) for x in cols]),
                          F.struct((-F.col("score")).alias("s"), kind_rank.alias("k"), "to_seq")).alias("_r"))
            .select("_r.*"))
    return _finish(best, lex)


def relationships(entities: DataFrame, trends: DataFrame | None = None, lex: Lexicon | None = None,
                  barriers: bool = True) -> DataFrame:
    rules = rule_relationships(entities, trends, lex)
    return rules.unionByName(barrier_relationships(entities, lex)) if barriers else rules


def relationship_id(entity_id_from: Column, entity_id_to: Column) -> Column:
    return stable_id("rel", F.concat_ws(":", F.col("patient_id").cast("string"), entity_id_from, entity_id_to,
                                        F.col("relation")))


def relationship_evidence(rels: DataFrame, members: DataFrame) -> DataFrame:
    """Bridge (relationship, fact): the facts of both endpoint entities, read in seq order."""
    m = members.select("patient_id", "entity_key", "fact_id", "event_id", "seq")
    ends = rels.select("patient_id", "from_key", "to_key", "relation", F.explode(
        F.array("from_key", "to_key")).alias("entity_key"))
    return ends.join(m, ["patient_id", "entity_key"]).select(
        "patient_id", "from_key", "to_key", "relation", "fact_id", "event_id", "seq")


# The texts of this function must read as they do.
def review_rows(rels: DataFrame) -> DataFrame:
    """One open review row per uncertain relationship."""
    return rels.filter(F.col("review_status") == "needs_review").select(
        "patient_id", F.lit("relationship").alias("target_type"),
        F.concat_ws("|", "from_key", "to_key", "relation").alias("target_id"),
        F.lit("Relationship requires review due to evidence uncertainty").alias("reason"), F.lit("open").alias("status"))


def is_symmetric(df: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Adds the symmetric flag of each row's relation."""
    lex = lex or Lexicon.default()
    flags = lex.relation_table(df.sparkSession).select("relation", "symmetric").distinct()
    return df.join(flags, "relation", "left").withColumn("symmetric", F.coalesce("symmetric", F.lit(False)))


def valid_relations(df: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Rows whose (from_kind, relation, to_kind) the relation table allows."""
    lex = lex or Lexicon.default()
    allowed = lex.relation_table(df.sparkSession).select("relation", "from_kind", "to_kind")
    return df.join(allowed, ["relation", "from_kind", "to_kind"], "left_semi")
