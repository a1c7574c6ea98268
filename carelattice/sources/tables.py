"""Knowledge tables on shared storage: schemas, scans, upserts, referential filters, deletes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.session import cut_lineage, remove_folder

BUCKETS = 64

# --- fixed values: table columns and upsert keys ------------------------------
TABLES = {
    "profiles": "id string, email string, name string, dob date",
    "sources": "id string, user_id string, type string, title string, captured_at timestamp, raw_text string, metadata string",
    "source_chunks": "id string, user_id string, source_id string, ordinal int, start_offset int, end_offset int, text string, metadata string",
    "extraction_runs": "id string, user_id string, source_id string, model string, prompt_version string, status string, started_at timestamp, completed_at timestamp, error string, metadata string",
    "candidate_facts": "id string, user_id string, source_id string, chunk_id string, kind string, label string, normalized_label string, value string, unit string, observed_at timestamp, status string, relevance string, confidence double, evidence_quote string, negated boolean, uncertain boolean, metadata string",
    "clinical_facts": "id string, user_id string, event_id string, source_id string, chunk_id string, entity_id string, kind string, label string, normalized_label string, value string, unit string, observed_at timestamp, status string, relevance string, confidence double, review_status string, provenance string, evidence_quote string, negated boolean, uncertain boolean, metadata string",
    "entities": "id string, user_id string, kind string, canonical_label string, confidence double, review_status string, metadata string",
    "entity_aliases": "id string, user_id string, entity_id string, alias string, confidence double",
    "graph_edges": "id string, user_id string, from_entity_id string, to_entity_id string, relation string, confidence double, review_status string, metadata string",
    "review_items": "id string, user_id string, target_type string, target_id string, reason string, status string, created_at timestamp",
    "risk_alerts": "id string, user_id string, severity string, title string, time_horizon string, specialty array<string>, explanation string, suggested_questions array<string>, metadata string",
}
UPSERT_KEYS = {"profiles": ["id"], "sources": ["id"], "source_chunks": ["id"], "candidate_facts": ["id"],
               "clinical_facts": ["event_id"], "entities": ["user_id", "kind", "canonical_key"],
               "graph_edges": ["user_id", "from_entity_id", "to_entity_id", "relation"], "review_items": ["id"]}
DELETE_ORDER = ["risk_alerts", "review_items", "graph_edges", "entity_aliases", "entities", "clinical_facts",
                "candidate_facts", "extraction_runs", "source_chunks", "sources"]
CHECKS = {
    "sources": "type in ('emr', 'voice', 'doctor_note', 'manual')",
    "extraction_runs": "status in ('completed', 'failed', 'fallback')",
    "candidate_facts": "relevance in ('graph', 'evidence_only', 'ignore') and confidence between 0 and 1",
    "clinical_facts": "relevance in ('graph', 'evidence_only', 'ignore') and confidence between 0 and 1 and review_status in ('accepted', 'needs_review', 'rejected', 'superseded')",
    "entities": "confidence between 0 and 1 and review_status in ('accepted', 'needs_review', 'rejected', 'superseded')",
    "entity_aliases": "confidence between 0 and 1",
    "graph_edges": "confidence between 0 and 1 and review_status in ('accepted', 'needs_review', 'rejected', 'superseded')",
    "review_items": "target_type in ('fact', 'entity', 'relationship', 'contradiction') and status in ('open', 'resolved')",
    "risk_alerts": "severity in ('high', 'medium', 'low')",
}
# --- end of fixed values ----------------------------------------------------


def bucket(user: str = "user_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def checked(table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) under the table's check constraint; an unknown (null) check passes, as in SQL."""
    rule = CHECKS.get(table)
    if rule is None:
        return rows, rows.limit(0)
    ok = F.coalesce(F.expr(rule), F.lit(True))
    return rows.filter(ok), rows.filter(~ok)


def keep_last(rows: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """Last row per key; copies collapse map-side."""
    cols = rows.columns
    key_cols = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*key_cols).agg(F.max_by(F.struct(*cols), order).alias("_r")).select("_r.*")


def scan(spark: SparkSession, root: str, table: str, user_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a table, of one user when given; the bucket filter prunes partitions."""
    df = spark.read.parquet(f"{root}/{table}")
    if user_id is None:
        return df
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(user_id)), F.lit(buckets)).cast("int").alias("b")).first()["b"]
    return df.filter((F.col("bucket") == b) & (F.col("user_id") == user_id))


def workspace_events(facts: DataFrame) -> DataFrame:
    """Stored facts re-projected as events."""
    return facts.select("event_id", F.col("user_id").alias("patient_id"), "source_id", "kind",
                        F.col("normalized_label").alias("label"), "value", "unit", "observed_at", "status",
                        F.col("id").alias("fact_id"), "confidence", "relevance", "review_status", "evidence_quote")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _replace_buckets(rows: DataFrame, path: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def upsert(root: str, table: str, new: DataFrame, order: str, keys: list[str] | None = None,
           user: str = "user_id", buckets: int = BUCKETS) -> None:
    """Insert or replace by key: the row with the greatest ``order`` stays.

    Only the buckets the new rows touch are read and rewritten.  The merged rows are
    checkpointed before the overwrite, because they derive from the files being replaced.
    """
    spark, path = new.sparkSession, f"{root}/{table}"
    keys = keys or UPSERT_KEYS[table]
    key_cols = [F.lower("canonical_label") if k == "canonical_key" else F.col(k) for k in keys]
    rows = keep_last(new.withColumn("bucket", bucket(user, buckets)), key_cols, order)
    if _exists(spark, path):
        # at most ``buckets`` small integers reach the driver
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        rows = keep_last(old.unionByName(rows, allowMissingColumns=True), key_cols, order)
        rows = cut_lineage(rows)
    _replace_buckets(rows, path)


def delete_user(spark: SparkSession, root: str, user_id: str, buckets: int = BUCKETS) -> None:
    """Remove one user's rows from every table, dependents first."""
    for table in DELETE_ORDER:
        path = f"{root}/{table}"
        if not _exists(spark, path):
            continue
        mine = scan(spark, root, table, user_id, buckets).select("bucket").distinct()
        hit = [r["bucket"] for r in mine.collect()]
        if not hit:
            continue
        bucket_rows = spark.read.parquet(path).filter(F.col("bucket").isin(hit))
        rest = cut_lineage(bucket_rows.filter(F.col("user_id") != user_id))
        # dynamic overwrite never empties a partition, so those without any other user are dropped
        for n in set(hit) - {r["bucket"] for r in rest.select("bucket").distinct().collect()}:
            remove_folder(spark, f"{path}/bucket={n}")
        _replace_buckets(rest, path)


# -- referential filters -----------------------------------------------------------------------

def with_existing_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    keys = sources.select(F.col("user_id"), F.col("id").alias("source_id"))
    return rows.join(keys, ["user_id", "source_id"], "left_semi")


def clear_dangling_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    known = chunks.select("user_id", F.col("id").alias("chunk_id"), F.lit(True).alias("_known")).distinct()
    return facts.join(known, ["user_id", "chunk_id"], "left").withColumn(
        "chunk_id", F.when(F.col("_known"), F.col("chunk_id"))).drop("_known")


def edges_between(edges: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("user_id", "id")
    out = edges.join(ids.withColumnRenamed("id", "from_entity_id"), ["user_id", "from_entity_id"], "left_semi")
    return out.join(ids.withColumnRenamed("id", "to_entity_id"), ["user_id", "to_entity_id"], "left_semi")


# -- shared reports ----------------------------------------------------------------------------

def share_reports(reports: DataFrame, root: str, created_at: Column, salt: str) -> DataFrame:
    """Store reports under an unguessable token (hash of a secret salt and the report key)."""
    token = F.concat(F.lit("shr_"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col("patient_id").cast("string"),
                                                                     "specialty", created_at.cast("string")), 256), 1, 32))
    rows = reports.withColumns({"token": token, "created_at": created_at}).withColumn("token_prefix", F.substring("token", 5, 2))
    # one file a prefix and write, in order of the token: a lookup reads one partition, and min/max values and the
    # Bloom filter on the token leave at most one row group of it
    (rows.repartition("token_prefix").sortWithinPartitions("token_prefix", "token").write.mode("append")
     .option("parquet.bloom.filter.enabled#token", "true").partitionBy("token_prefix").parquet(f"{root}/shared_reports"))
    return rows.select("token", "patient_id", "specialty", "created_at")


def shared_report(spark: SparkSession, root: str, token: str) -> DataFrame:
    """Point lookup; the token prefix prunes to one partition, the token to a row group."""
    return spark.read.parquet(f"{root}/shared_reports").filter(
        (F.col("token_prefix") == token[4:6]) & (F.col("token") == token))


def shared_reports_of(spark: SparkSession, root: str, tokens: DataFrame) -> DataFrame:
    """Lookup of many tokens (column token); those that nobody shared give nothing."""
    asked = tokens.select("token", F.substring("token", 5, 2).alias("token_prefix")).distinct()
    return spark.read.parquet(f"{root}/shared_reports").join(asked, ["token_prefix", "token"], "left_semi")
