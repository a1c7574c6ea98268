"""Incremental processing: recompute what a micro-batch touches, and streaming deduplication and trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelattice.lexicon import Lexicon
from carelattice.operators.facts import fact_fingerprint
from carelattice.operators.grounding import ground
from carelattice.operators.trends import trend_summary
from carelattice.session import cut_lineage, folder_exists, remove_folder
from carelattice.sources.tables import BUCKETS, bucket

Derive = Callable[[DataFrame], dict[str, DataFrame]]


def apply_batch(batch: DataFrame, batch_id: int, root: str, derive: Derive, buckets: int = BUCKETS) -> None:
    """Store a micro-batch and rederive the patients it touches.

    Only the touched patients' events are derived again.  In the buckets these patients live in, their old output rows are
    replaced, those of other patients are carried over as they are; a row that is no longer derived goes, also
    when it was the last of its bucket.  Events are written under the batch's number and outputs by whole buckets, so
    replaying a batch after a failure changes nothing."""
    spark = batch.sparkSession
    rows = batch.withColumns({"bucket": bucket("patient_id", buckets), "batch_id": F.lit(batch_id)})
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id")
     .parquet(f"{root}/events"))
    events = spark.read.parquet(f"{root}/events")
    touched = cut_lineage(events.filter(F.col("batch_id") == batch_id).select("patient_id", "bucket").distinct())
    # bucket numbers only: bounded by ``buckets``
    numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    if not numbers:
        return
    mine = events.filter(F.col("bucket").isin(numbers)).join(touched.select("patient_id"), "patient_id", "left_semi")
    for name, out in derive(mine.drop("bucket", "batch_id")).items():
        path = f"{root}/{name}"
        new = cut_lineage(out.withColumn("bucket", bucket("patient_id", buckets)))
        if not folder_exists(spark, path):
            new.write.partitionBy("bucket").parquet(path)
            continue
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(numbers))
        kept = cut_lineage(old.join(touched.select("patient_id"), "patient_id", "left_anti").select(*new.columns))
        both = kept.unionByName(new)
        for n in set(numbers) - {r["bucket"] for r in both.select("bucket").distinct().collect()}:
            remove_folder(spark, f"{path}/bucket={n}")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def run_incremental(events: DataFrame, root: str, derive: Derive, checkpoint: str, buckets: int = BUCKETS,
                    available_now: bool = True) -> StreamingQuery:
    """Start the stream; each micro-batch goes through ``apply_batch``."""
    writer = events.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, root, derive, buckets)) \
                   .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def streaming_dedup(events: DataFrame, delay: str, lex: Lexicon | None = None, arrived_at: str | None = None) -> DataFrame:
    """First arrival per fact fingerprint; a fingerprint is remembered for ``delay`` after it arrived.

    Time is when a row arrives (column ``arrived_at``, or the time of processing), never when a fact was observed: facts are often
    years old when they come, and none is dropped for that."""
    g = ground(events, lex)
    keys = {f"_k{i}": k for i, k in enumerate(fact_fingerprint())}
    named = g.withColumns(keys | {"_arrived": F.current_timestamp() if arrived_at is None else F.col(arrived_at)})
    return named.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_arrived", *keys)


def streaming_trends(events: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """The trend summary of a stream, for update mode: its state is one row of fixed size per series, and a trigger gives the
    series it changed."""
    return trend_summary(events, lex)


def append_changes(changed: DataFrame, batch_id: int, path: str) -> None:
    """Sink of an update-mode query: the changed rows under their batch's number; a replay replaces them."""
    rows = changed.withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What append_changes() wrote, the last state of each key; series that did not change are not written again."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch_id").alias("_r")).select("_r.*")


def trend_stream(events: DataFrame, path: str, checkpoint: str, lex: Lexicon | None = None) -> StreamingQuery:
    """Keep the trend table at ``path`` up to date with all there is of a stream of events; read it with latest_rows()."""
    writer = streaming_trends(events, lex).writeStream.outputMode("update").foreachBatch(lambda df, n: append_changes(df, n, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
