"""Lab and vital trends: clinical summaries, per-metric statistics, series and catalog.

All aggregates are algebraic (min_by / max_by / count / regression sums), so each
combines map-side and one huge series is never gathered in a task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import js_round
from carelattice.functions.values import drift, is_worsening, reading, strict_number
from carelattice.lexicon import Lexicon
from carelattice.operators.grounding import ground


def measurements(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin("lab", "vital"))


def trend_aggregates(value: Column, at: str = "observed_at", seq: str = "seq") -> list[Column]:
    """Aggregate columns of a time-ordered series; ties keep arrival order."""
    order = F.struct(F.col(at), F.col(seq))
    return [F.count(value).alias("points"),
            F.min_by(value, F.when(value.isNotNull(), order)).alias("first_value"),
            F.max_by(value, F.when(value.isNotNull(), order)).alias("last_value"),
            F.max_by(F.col("unit"), F.when(value.isNotNull(), order)).alias("last_unit"),
            F.min(F.when(value.isNotNull(), F.col(at))).alias("first_observed_at"),
            F.max(F.when(value.isNotNull(), F.col(at))).alias("last_observed_at"),
            F.min(F.when(value.isNotNull(), F.col(seq))).alias("first_numeric_seq"),
            F.min_by(F.col(seq), F.when(value.isNotNull(), F.struct((-F.unix_micros(at)).alias("t"), F.col(seq))))
            .alias("newest_seq")]


def judge(df: DataFrame) -> DataFrame:
    """delta, direction of movement and the worsening flag from the series aggregates."""
    raw = F.col("last_value") - F.col("first_value")
    delta = F.signum(raw) * F.floor(F.abs(raw) * 100 + 0.5) / 100
    moved = drift(F.col("first_value"), F.col("last_value"))
    return (df.withColumn("delta", delta + 0.0).withColumn("moved", moved)
            .withColumn("worsening", is_worsening(F.col("direction"), F.col("moved"))))


def trend_summary(events: DataFrame, lex: Lexicon | None = None, grounded: bool = False) -> DataFrame:
    """One row per (patient, canonical measurement) with two or more numeric readings."""
    g = events if grounded else ground(measurements(events), lex)
    series = (measurements(g).withColumn("_v", reading(F.col("value"))).filter(F.col("_v").isNotNull())
              .groupBy("patient_id", F.lower("canonical").alias("series_key"))
              .agg(F.min("canonical").alias("label"), F.min("ref_unit").alias("ref_unit"),
                   F.min("direction").alias("direction"), *trend_aggregates(F.col("_v")))
              .filter(F.col("points") >= 2))
    return judge(series).select(
        "patient_id", "series_key", "label",
        F.when(F.coalesce(F.col("ref_unit"), F.lit("")) != "", F.col("ref_unit"))
        .otherwise(F.col("last_unit")).alias("unit"),
        "points", "first_value", "last_value", "delta", F.col("moved").alias("direction"), "worsening",
        "first_observed_at", "last_observed_at", "newest_seq")


# -- metric tools: raw labels, strictly numeric values -----------------------------------------

def within_days(at: Column, days: int | None, as_of: dt.datetime | None) -> Column:
    """Recency predicate; a missing or non-positive window keeps everything."""
    if not days or days <= 0:
        return F.lit(True)
    if as_of is None:
        raise ValueError("a recency window needs as_of")
    return at >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp")


def numeric_events(events: DataFrame) -> DataFrame:
    return (measurements(events).withColumn("number", strict_number(F.col("value")))
            .filter(F.col("number").isNotNull()))


def metric_catalog(events: DataFrame) -> DataFrame:
    return (numeric_events(events).groupBy("patient_id", F.col("label").alias("metric"))
            .agg(F.count(F.lit(1)).alias("readings"), F.min_by("unit", "seq").alias("unit"),
                 F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed")))


def metric_series(events: DataFrame, metric: str | None = None, days: int | None = None,
                  as_of: dt.datetime | None = None) -> DataFrame:
    """Data points in long form; order by (observed_at, seq)."""
    rows = numeric_events(events).filter(within_days(F.col("observed_at"), days, as_of))
    if metric is not None:
        rows = rows.filter(F.col("label") == metric)
    return rows.select("patient_id", F.col("label").alias("metric"), "seq", "event_id", "observed_at",
                       F.col("number").alias("value"), "unit")


def trend_stats(events: DataFrame, metric: str | None = None, days: int | None = None,
                as_of: dt.datetime | None = None) -> DataFrame:
    """First, last, percent change, slope per day and direction at five percent."""
    s = metric_series(events, metric, days, as_of)
    order = F.struct("observed_at", "seq")
    day = F.unix_micros("observed_at") / F.lit(86400000000.0)
    agg = s.groupBy("patient_id", "metric").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("value", order).alias("_first"),
        F.max_by("value", order).alias("_last"), F.min_by("unit", order).alias("_unit"),
        F.coalesce(F.regr_slope(F.col("value"), day), F.lit(0.0)).alias("_slope"),
        F.min("observed_at").alias("_start"), F.max("observed_at").alias("_end"))
    enough = F.col("points") >= 2
    pct = F.when(F.col("_first") != 0, (F.col("_last") - F.col("_first")) / F.abs("_first") * 100).otherwise(0.0)
    return agg.select(
        "patient_id", "metric", "points",
        F.when(enough, F.col("_first")).alias("first_value"), F.when(enough, F.col("_last")).alias("last_value"),
        F.when(enough, F.col("_unit")).alias("unit"), F.when(enough, js_round(pct)).alias("pct_change"),
        F.when(enough, js_round(F.col("_slope"))).alias("slope_per_day"),
        F.when(enough & (F.abs(pct) >= 5), F.when(F.col("_last") > F.col("_first"), "increasing")
               .otherwise("decreasing")).otherwise("stable").alias("direction"),
        F.when(~enough, "insufficient data").alias("reason"),
        F.when(enough, F.col("_start")).alias("window_start"), F.when(enough, F.col("_end")).alias("window_end"))


def query_events(events: DataFrame, kind: str | None = None, label_pattern: str | None = None,
                 days: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Events by kind, case-insensitive label pattern and recency."""
    keep = within_days(F.col("observed_at"), days, as_of)
    if kind:
        keep = keep & (F.col("kind") == kind)
    if label_pattern:
        keep = keep & F.col("label").rlike("(?i)" + label_pattern)
    return events.filter(keep).select("patient_id", "seq", "event_id", "kind", "label", "value", "unit",
                                      "observed_at", "status")
