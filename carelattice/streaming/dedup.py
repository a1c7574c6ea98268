"""Exact first-arrival deduplication of a stream against everything that ever arrived.

What has been seen is a stored table of keys in hash buckets, with a Bloom filter in front: two bits a key, kept as
bitmaps per bucket.  A row of a micro-batch one of whose bits is unset is new without a look at the table; only the others
are joined with the keys, and only the buckets they fall into are read.  Nothing is forgotten after a delay, and the
state is files, so it may be larger than any memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelattice.operators.facts import first_wins
from carelattice.session import cut_lineage, folder_exists
from carelattice.sources.tables import BUCKETS

BITMAP = 32768  # bits in one of Spark's bitmaps
BITMAPS = 32    # of a bucket, for each of the two hashes


def _place(names: list[str], hash_no: int) -> Column:
    """The bit of a key in its bucket's filter."""
    return F.pmod(F.xxhash64(F.lit(hash_no), *names), F.lit(BITMAP * BITMAPS))


def _bit(bitmap: str, bit: str) -> Column:
    """Whether a bit of a bitmap is set; an absent bitmap has none."""
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0, F.lit(False))


def _filter_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """(bucket, hash_no, bitmap_no, bit) of each key."""
    places = F.array(*(F.struct(F.lit(k).alias("hash_no"), _place(names, k).alias("place")) for k in (0, 1)))
    bits = rows.select("bucket", F.explode(places).alias("p"))
    return bits.select("bucket", "p.hash_no", F.expr(f"cast(p.place div {BITMAP} as int)").alias("bitmap_no"), (F.col("p.place") % BITMAP).alias("bit"))


def _maybe_seen(rows: DataFrame, names: list[str], filters: DataFrame) -> DataFrame:
    """``rows`` with _maybe: false only for keys that certainly are not in the table."""
    joined, flags = rows, []
    for k in (0, 1):
        place = _place(names, k)
        one = filters.where(F.col("hash_no") == k).select("bucket", F.col("bitmap_no").alias(f"_n{k}"), F.col("bitmap").alias(f"_m{k}"))
        joined = joined.withColumns({f"_n{k}": F.expr(f"cast(pmod(xxhash64({k}, {', '.join(names)}), {BITMAP * BITMAPS}L) div {BITMAP} as int)"), f"_b{k}": place % BITMAP})
        joined = joined.join(one, ["bucket", f"_n{k}"], "left")
        flags.append(_bit(f"_m{k}", f"_b{k}"))
    return joined.select(*rows.columns, (flags[0] & flags[1]).alias("_maybe"))


def dedup_batch(batch: DataFrame, batch_id: int, root: str, keys: list[Column], order: str, buckets: int = BUCKETS) -> None:
    """Append the batch's rows whose keys came neither in it before nor in any earlier batch to ``root``/rows.

    ``keys``: named columns; nulls are equal to nulls.  Keys, filters and rows are written under the batch's number
    and earlier batches alone count as seen, so replaying the last batch after a failure changes nothing."""
    spark = batch.sparkSession
    keyed = batch.select("*", *keys)
    names = keyed.columns[len(batch.columns):]
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    rows = cut_lineage(first_wins(keyed, names, order).withColumn("bucket", bucket))
    new = rows
    if folder_exists(spark, f"{root}/filter"):
        earlier = spark.read.parquet(f"{root}/filter").where(F.col("batch_id") < batch_id)
        filters = earlier.groupBy("bucket", "hash_no", "bitmap_no").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))  # as large as buckets say
        judged = cut_lineage(_maybe_seen(rows, names, filters))
        maybe = judged.where("_maybe").drop("_maybe")
        numbers = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # ``buckets`` at most
        seen = spark.read.parquet(f"{root}/seen").where(F.col("bucket").isin(numbers) & (F.col("batch_id") < batch_id)).select(
            *(F.col(n).alias(f"_s{i}") for i, n in enumerate(names)))
        same = [F.col(n).eqNullSafe(F.col(f"_s{i}")) for i, n in enumerate(names)]
        new = judged.where("not _maybe").drop("_maybe").unionByName(maybe.join(seen, same, "left_anti"))
    new = cut_lineage(new.withColumn("batch_id", F.lit(batch_id)))
    dynamic = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic(new.drop(*names, "bucket")).partitionBy("batch_id").parquet(f"{root}/rows")
    dynamic(new.select(*names, "bucket", "batch_id").repartition("bucket")).partitionBy("bucket", "batch_id").parquet(f"{root}/seen")
    bits = _filter_rows(new, names).groupBy("bucket", "hash_no", "bitmap_no").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    dynamic(bits.withColumn("batch_id", F.lit(batch_id))).partitionBy("batch_id").parquet(f"{root}/filter")


def dedup_stream(rows: DataFrame, root: str, checkpoint: str, keys: list[Column], order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Run dedup_batch() over all there is of a stream of rows."""
    writer = rows.writeStream.foreachBatch(lambda df, n: dedup_batch(df, n, root, keys, order, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
