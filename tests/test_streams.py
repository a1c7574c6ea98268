import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carelattice.operators.trends import trend_summary
from carelattice.sources import tables
from carelattice.streaming import dedup, incremental

def keys():
    return [F.col("a").alias("_k0"), F.col("b").alias("_k1")]



def batches_of(rng, n, size):
    seq, out = 0, []
    for _ in range(n):
        rows = []
        for _ in range(size):
            rows.append((rng.choice([None, "x", "y", "z"]), rng.choice([None, *range(40)]), seq))
            seq += 1
        out.append(rows)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_dedup_against_all_earlier_batches(spark, tmp_path, monkeypatch, small):
    """First arrivals over batches far apart, with null keys and a replayed batch; a filter that is nearly full changes nothing."""
    if small:
        monkeypatch.setattr(dedup, "BITMAPS", 1)
        monkeypatch.setattr(dedup, "BITMAP", 16)
    rng, root = random.Random(4), str(tmp_path)
    batches = batches_of(rng, 5, 60)
    for n, rows in [*enumerate(batches), (4, batches[4])]:
        dedup.dedup_batch(spark.createDataFrame(rows, "a string, b int, seq long"), n, root, keys(), "seq", buckets=4)
    first = {}
    for rows in batches:
        for a, b, seq in rows:
            first.setdefault((a, b), seq)
    got = {(r.a, r.b): r.seq for r in spark.read.parquet(f"{root}/rows").collect()}
    assert got == first and spark.read.parquet(f"{root}/rows").count() == len(first)


def test_the_filter_never_misses_and_mostly_knows(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("a"), F.lit(1).alias("b"), F.col("id").alias("seq"))
    dedup.dedup_batch(rows, 0, str(tmp_path), keys(), "seq", buckets=4)
    filters = spark.read.parquet(f"{tmp_path}/filter").groupBy("bucket", "hash_no", "bitmap_no").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    asked = spark.range(4000).select(F.col("id"), F.col("id").cast("string").alias("_k0"), F.lit(1).alias("_k1"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("_k0", "_k1"), F.lit(4)).cast("int"))
    flagged = dedup._maybe_seen(asked, ["_k0", "_k1"], filters).groupBy((F.col("id") < 2000).alias("old")).agg(F.sum(F.col("_maybe").cast("int")).alias("n")).collect()
    found = {r.old: r.n for r in flagged}
    assert found[True] == 2000 and found[False] < 20


def test_dedup_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    batches, first = batches_of(random.Random(8), 3, 40), {}
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "a string, b int, seq long")
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        dedup.dedup_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", keys(), "seq", 4).awaitTermination()
        for a, b, seq in rows:
            first.setdefault((a, b), seq)
    assert {(r.a, r.b): r.seq for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()} == first


def test_trend_stream_writes_only_changed_series(spark, make_events, tmp_path):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = [dict(kind="lab", label="HbA1c", value=str(6 + n / 2), at=day(n), id=f"a{n}") for n in range(4)]
    rows += [dict(kind="vital", label="Weight", value=str(150 + n), at=day(n), id=f"w{n}") for n in range(2)]
    rows += [dict(kind="lab", label="a1c", value="5.5", at=day(-3), id="late"), dict(kind="lab", label="TSH", value="none", id="t")]
    events = make_events(*rows)
    lots = [events.filter(F.col("event_id").isin("a0", "a1", "w0", "w1")), events.filter(F.col("event_id").isin("a2", "a3")), events.filter(F.col("event_id").isin("late", "t"))]
    for lot in lots:
        lot.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        incremental.trend_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = incremental.latest_rows(spark, f"{tmp_path}/out", ["patient_id", "series_key"])
    want = trend_summary(events)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and want.count() == 2
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("series_key").count().count() == 2
    assert {r["series_key"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("series_key").count().collect()}["weight"] == 1


def test_a_thousand_shares(spark, tmp_path):
    reports = spark.range(1000).select(F.concat(F.lit("p"), F.col("id")).alias("patient_id"), F.lit("cardiology").alias("specialty"), F.col("id").alias("body"))
    tokens = tables.share_reports(reports, str(tmp_path), F.lit("2026-08-01").cast("timestamp"), "salt").collect()
    assert len({t.token for t in tokens}) == 1000
    for t in tokens[::250]:
        found = tables.shared_report(spark, str(tmp_path), t.token).collect()
        assert [(r.patient_id, f"p{r.body}") for r in found] == [(t.patient_id, t.patient_id)]
    assert tables.shared_report(spark, str(tmp_path), tokens[0].token[:-1] + "z").isEmpty()
    asked = spark.createDataFrame([(t.token,) for t in tokens[:300]] + [("shr_00wrong",), (tokens[0].token,)], "token string")
    assert sorted(r.patient_id for r in tables.shared_reports_of(spark, str(tmp_path), asked).collect()) == sorted(t.patient_id for t in tokens[:300])
    plan = tables.shared_report(spark, str(tmp_path), tokens[0].token)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(token_prefix" in plan and "EqualTo(token,shr_" in plan
