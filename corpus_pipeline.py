"""Documents to packed training sequences: five stages, each writing a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm import lines, mixing, packing, rules, simhash
from carelattice.session import cut_lineage

SHARES = [0.96, 0.02, 0.02]  # of clean, junk and toxic text after mixing
GROWTH = 1.1                 # clean text is taken so often, so that mixing does not thin it out


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts are judged by their statistics like any other, repeated rows alike; very long texts are read whole.  All columns
    stay, whatever their names.  No labelled documents: all are scored alike.  Empty table: no rows."""
    model = rules.train(docs, _labels(spark, sf_dir), "quality")
    rows = docs.select(F.struct("*").alias("row"), "text")
    return rules.score(rules.statistics(rows, keep=("row",)), model, 0.3).where("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, except in the first document that has them; no document goes."""
    kept = lines.dedup(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return simhash.one_of_each(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates that bring the domains to SHARES; at a rate below 1 some go.

    Null and empty texts count no tokens and move no total.  Copies are drawn by doc_id and text, so equal rows stay or go
    together.  All columns stay, whatever their names.  Empty table: no rows."""
    model = mixing.train(docs, mixing.domain_labels(_labels(spark, sf_dir)))
    soft = cut_lineage(mixing.members(docs, model))
    targets = mixing.grown_targets(mixing.totals(soft, len(SHARES)), SHARES, 0, GROWTH)
    rated, _ = mixing.rates(soft, targets)
    return mixing.repeated(docs, rated.withColumn("copies", mixing.copies(F.col("rate"), "doc_id", "text_key")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a repeated document is packed as often as it comes.

    Null and empty texts are one end id; null ids are packed like others; long texts are cut at the capacity.  Other columns are not
    read.  Empty table: no rows."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("mixing to target weights", mix), ("best-fit packing", pack)]
ORACLE_SQL = None  # models and fingerprints; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
