"""Entity resolution: exact collapse, fuzzy match of unknown labels, clustering, golden records.

Fact-level work is one algebraic aggregation to clusters; everything after it runs on
clusters.  Members (facts, aliases) are bridge tables, never arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import stable_id
from carelattice.lexicon import Lexicon
from carelattice.operators.components import connected_components
from carelattice.operators.grounding import CONCEPT_COLUMNS, specialties_or_default
from carelattice.operators.similarity import similar_pairs
from carelattice.session import cut_large

MERGE_THRESHOLD = 0.84  # fixed value
_CLUSTER = ["patient_id", "block", "cluster_key"]


def graph_facts(facts: DataFrame, block_by_event_kind: bool = False) -> DataFrame:
    """Facts that may become entities, with their block and exact cluster key.

    ``block_by_event_kind`` keeps barriers and care tasks in blocks of their own instead
    of the concept kind their label happens to ground to.
    """
    block = F.col("concept_kind")
    if block_by_event_kind:
        block = F.when(F.col("kind") == "barrier", "barrier").when(F.col("kind") == "care_task", "task").otherwise(block)
    own = block != F.col("concept_kind")
    key = (F.when(own, F.concat(F.lit("label:"), F.lower("normalized_label")))
           .when(F.col("coding_code").isNotNull(), F.concat(F.lit("code:"), "coding_system", F.lit(":"), "coding_code"))
           .otherwise(F.concat(F.lit("label:"), F.lower("canonical"))))
    return (facts.filter(F.col("relevance") == "graph").withColumn("block", block)
            .withColumn("cluster_key", key)
            .withColumn("_concept", F.when(~own, F.col("concept_id"))))


def clusters(gfacts: DataFrame) -> DataFrame:
    return gfacts.groupBy(*_CLUSTER).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("facts"), F.min("_concept").alias("concept_id"),
        F.min_by("canonical", "seq").alias("canonical"), F.min_by("normalized_label", "seq").alias("label"),
        F.min("confidence").alias("confidence"), F.max(F.col("review_status") == "needs_review").alias("needs_review"),
        F.min_by("kind", "seq").alias("first_kind"))


def merge_edges(cl: DataFrame) -> DataFrame:
    """Pairs of clusters of one patient to merge.  Two known concepts never merge by
    spelling, so similarity runs within the patient on labels with at least one unknown side."""
    labels = cl.groupBy("patient_id", "block", F.col("canonical").alias("label")).agg(
        F.max(F.col("concept_id").isNull()).alias("left"), F.lit(True).alias("right"))
    pairs = similar_pairs(labels, MERGE_THRESHOLD, ("patient_id", "block")).select("patient_id", "block", "a", "b")
    left = cl.select("patient_id", "block", F.col("canonical").alias("a"), F.col("cluster_key").alias("ka"))
    right = cl.select("patient_id", "block", F.col("canonical").alias("b"), F.col("cluster_key").alias("kb"))
    return (left.join(pairs, ["patient_id", "block", "a"]).join(right, ["patient_id", "block", "b"])
            .select("patient_id", "block", F.col("ka").alias("a"), F.col("kb").alias("b")))


def cluster_roots(cl: DataFrame) -> DataFrame:
    """Each cluster with the root of its merged group (itself when nothing merges)."""
    roots = connected_components(merge_edges(cl), ["patient_id", "block"]).withColumnRenamed("node", "cluster_key")
    return cl.join(roots, _CLUSTER, "left").withColumn("root", F.coalesce("root", "cluster_key"))


def golden_records(rooted: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Survivorship: the first known concept names the entity, else the most frequent label
    (ties: longer, then earlier); lowest confidence and any open review carry over."""
    lex = lex or Lexicon.default()
    known_first = F.when(F.col("concept_id").isNotNull(), F.col("first_seq"))
    g = rooted.groupBy("patient_id", F.col("block").alias("kind"), "root").agg(
        F.min("first_seq").alias("first_seq"), F.sum("facts").alias("facts"),
        F.min_by("concept_id", known_first).alias("concept_id"),
        F.min_by("canonical", known_first).alias("_known"),
        F.min_by("label", F.struct((-F.col("facts")).alias("n"), (-F.length("label")).alias("l"), "first_seq"))
        .alias("_frequent"),
        F.min("confidence").alias("confidence"), F.max("needs_review").alias("needs_review"),
        F.min_by("first_kind", "first_seq").alias("first_kind"))
    label = F.coalesce("_known", "_frequent")
    concept = lex.concept_table(rooted.sparkSession).select("concept_id", *CONCEPT_COLUMNS)
    return (g.withColumn("canonical_label", label)
            .withColumn("entity_key", F.concat_ws(":", "kind", F.lower("canonical_label")))
            .join(concept, "concept_id", "left")
            .withColumn("specialties", specialties_or_default(F.coalesce("specialties", F.array().cast("array<string>"))))
            .withColumn("review_status", F.when(F.col("needs_review"), "needs_review").otherwise("accepted"))
            .drop("_known", "_frequent", "needs_review"))


def with_entity_id(entities: DataFrame) -> DataFrame:
    return entities.withColumn("entity_id", stable_id("entity", F.concat_ws(
        ":", F.col("patient_id").cast("string"), F.col("kind"), F.lower("canonical_label"))))


def entity_members(gfacts: DataFrame, rooted: DataFrame, entities: DataFrame) -> DataFrame:
    """Bridge (patient, entity, fact): order by (cluster_seq, seq) for the original fact order."""
    keys = (rooted.select(*_CLUSTER, "root", F.col("first_seq").alias("cluster_seq"))
            .join(entities.select("patient_id", F.col("kind").alias("block"), "root", "entity_key"),
                  ["patient_id", "block", "root"]).drop("root"))
    return (gfacts.join(keys, _CLUSTER)
            .select("patient_id", "entity_key", "fact_id", "event_id", "source_id", "cluster_seq", "seq", "kind", "label",
                    "value", "unit", "observed_at", "confidence", "review_status"))


def entity_aliases(members: DataFrame) -> DataFrame:
    """Distinct raw labels of an entity; order by (cluster_seq, seq)."""
    return (members.filter(F.coalesce("label", F.lit("")) != "").groupBy("patient_id", "entity_key", F.col("label").alias("alias"))
            .agg(F.min("cluster_seq").alias("cluster_seq"), F.min("seq").alias("seq")))


def resolve(facts: DataFrame, lex: Lexicon | None = None, block_by_event_kind: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, members).  The cluster table is small beside the facts and read by every
    later step, so it is cut from the event lineage once, by a written table."""
    gf = graph_facts(facts, block_by_event_kind)
    rooted = cluster_roots(cut_large(clusters(gf)))
    entities = golden_records(rooted, lex)
    return entities, entity_members(gf, rooted, entities)
