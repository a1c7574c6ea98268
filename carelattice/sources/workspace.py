"""Workspaces in catalog tables that are bucketed along their references and sorted by user.

A table and the one it refers to have the same buckets, so checking references on the way in and joining them on the way
out exchange nothing.  Within a bucket rows are sorted by user, so one user's workspace is a few row groups of each file.  A
write makes a new version of a table; the view of the table's name always shows the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carelattice.sources.tables import TABLES, UPSERT_KEYS, checked, keep_last, workspace_events

BUCKETS = 16
# table: the columns it is bucketed by, the table they refer to
LAYOUT = {"profiles": (["id"], None), "sources": (["user_id", "id"], None), "source_chunks": (["user_id", "source_id"], "sources"),
          "clinical_facts": (["user_id", "source_id"], "sources"), "entities": (["user_id", "id"], None),
          "entity_aliases": (["user_id", "entity_id"], "entities"), "graph_edges": (["user_id", "from_entity_id"], "entities")}


def _name(workspace: str, table: str) -> str:
    return f"{workspace}_{table}"


def conformed(table: str, rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` with the table's columns in the table's types, and ``more`` of their own; columns that are not there are null."""
    schema = StructType.fromDDL(TABLES[table])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), *more)


def current(spark: SparkSession, workspace: str, table: str) -> DataFrame | None:
    """All rows of a table's last version; None before the first write."""
    return spark.table(_name(workspace, table)) if spark.catalog.tableExists(_name(workspace, table)) else None


def referring(workspace: str, table: str, rows: DataFrame) -> DataFrame:
    """The rows whose parent is stored; rows without a reference stay out too."""
    keys, parent = LAYOUT[table]
    known = None if parent is None else current(rows.sparkSession, workspace, parent)
    if parent is None:
        return rows
    if known is None:
        return rows.limit(0)
    return rows.join(known.select("user_id", F.col("id").alias(keys[1])), keys, "left_semi").select(*rows.columns)


def write(workspace: str, root: str, table: str, rows: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Insert or replace by the table's key; of new rows with one key the one with the greatest ``order`` (a number) stays, and
    any replaces a stored one.  Rows that break a check or refer to nothing are not stored but returned, with a reason."""
    spark, keys = rows.sparkSession, LAYOUT[table][0]
    ok, broken = checked(table, conformed(table, rows, F.col(order).cast("long").alias("_order")))
    kept = referring(workspace, table, ok)
    unique = [F.lower("canonical_label") if k == "canonical_key" else F.col(k) for k in UPSERT_KEYS.get(table, ["id"])]
    unique = unique if table == "profiles" else [F.col("user_id"), *unique]
    old = current(spark, workspace, table)
    if old is not None:
        kept = kept.unionByName(old.withColumn("_order", F.lit(-(1 << 63))))
    merged = keep_last(kept, unique, "_order").drop("_order")
    version = f"{_name(workspace, table)}_{uuid.uuid4().hex}"
    (merged.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", f"{root}/{table}/{version}").saveAsTable(version))
    spark.table(version).createOrReplaceTempView(_name(workspace, table))
    lost = ok.join(referring(workspace, table, ok).select("id"), "id", "left_anti") if LAYOUT[table][1] else ok.limit(0)
    return broken.withColumn("reason", F.lit("check")).unionByName(lost.withColumn("reason", F.lit("reference"))).drop("_order")


def load(spark: SparkSession, workspace: str, user_id: str) -> dict[str, DataFrame]:
    """The tables of one user, without whom nothing is read; ``events`` are the stored facts as events."""
    if not user_id:
        raise ValueError("a workspace belongs to a user")
    found = {}
    for table in LAYOUT:
        rows = current(spark, workspace, table)
        if rows is not None:
            found[table] = rows.filter(F.col("id" if table == "profiles" else "user_id") == user_id)
    if "clinical_facts" in found:
        found["events"] = workspace_events(found["clinical_facts"])
    return found


def facts_with_sources(spark: SparkSession, workspace: str) -> DataFrame:
    """Stored facts of all users with their source's title and type; both have the same buckets, so neither is exchanged."""
    facts, sources = current(spark, workspace, "clinical_facts"), current(spark, workspace, "sources")
    return facts.join(sources.select("user_id", F.col("id").alias("source_id"), "title", F.col("type").alias("source_type")), ["user_id", "source_id"])
