"""Proposals from an external reasoner (edges, alerts, trends, citations), checked against the record.

Free-text labels are matched by exact equi-join first; the containment fallback runs only on
labels that found nothing, through shared short pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carelattice.lexicon import REPORT_SPECIALTIES, Lexicon
from carelattice.operators.graph import edge_id
from carelattice.operators.relationships import valid_relations
from carelattice.operators.risk import SEVERITIES, severity_rank
from carelattice.session import cut_large, cut_lineage

# --- fixed values -----------------------------------------------------------
PROPOSED_CONFIDENCE, EXTRA_ALERTS = 0.7, 2
# --- end of fixed values ----------------------------------------------------


def _pieces(c: Column) -> Column:
    """All substrings of one to three characters."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(
        c.substr(i, F.lit(1)), c.substr(i, F.lit(2)), c.substr(i, F.lit(3))))))


def _key(c: Column) -> Column:
    """First three characters: a text containing ``c`` has them among its pieces."""
    return F.substring(c, 1, 3)


def _containing(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """Rows of ``parts`` and ``wholes`` of one patient where the text ``whole`` contains the text ``part``.  Of the pieces of a whole,
    many times the rows, only those that some part begins with leave the scan."""
    keyed = parts.withColumn("g", _key(F.col(part)))
    begin = cut_lineage(keyed.select("g").distinct())  # at most as many as there are beginnings of three characters
    pieces = wholes.select("*", F.explode(_pieces(F.col(whole))).alias("g")).join(F.broadcast(begin), "g", "left_semi")
    return keyed.join(pieces.hint("merge"), ["patient_id", "g"]).filter(F.contains(F.col(whole), F.col(part)) & (F.col(part) != "")).drop("g")


def fuzzy_lookup(labels: DataFrame, targets: DataFrame, order: str, exact_first: bool = True) -> DataFrame:
    """Match each (patient_id, label) to the first target of the patient whose text equals, contains or is
    contained in the label.  ``targets`` has patient_id, target_id, text and the ``order`` column.

    A text that contains another has the other's first characters among its pieces, so distinct
    texts meet through equi-joins on (patient, piece) and are then checked.
    """
    ask = labels.select("patient_id", F.lower("label").alias("q"), F.col("label").alias("raw")).distinct()
    ask, t = cut_large(ask), cut_large(targets.groupBy("patient_id", F.lower("text").alias("t")).agg(
        F.min_by("target_id", order).alias("target_id"), F.min(order).alias("_o")))
    exact = ask.join(t.withColumnRenamed("t", "q"), ["patient_id", "q"]).select("patient_id", "raw", "target_id", "_o",
                                                                                  F.lit(0).alias("_p"))
    rest = ask.join(exact.select("patient_id", "raw"), ["patient_id", "raw"], "left_anti") if exact_first else ask
    cols = ["patient_id", "raw", "q", "t", "target_id", "_o"]
    near = _containing(rest, "q", t, "t").select(*cols).unionByName(_containing(t, "t", rest, "q").select(*cols))
    every = exact.unionByName(near.select("patient_id", "raw", "target_id", "_o", F.lit(1).alias("_p")))
    rank = F.struct("_p", "_o") if exact_first else F.struct("_o")
    return every.groupBy("patient_id", F.col("raw").alias("label")).agg(F.min_by("target_id", rank).alias("target_id"))


def proposed_edges(proposals: DataFrame, nodes: DataFrame, node_events: DataFrame, existing: DataFrame,
                   lex: Lexicon | None = None) -> DataFrame:
    """Valid, new edges from (patient_id, pos, from_label, to_label, relation, reason).

    Both ends must resolve to different nodes and satisfy the relation's domain and range; the
    first of equal edges wins; edges the graph already has are dropped.
    """
    targets = nodes.select("patient_id", F.col("node_id").alias("target_id"), F.col("label").alias("text"), "ord")
    asked = proposals.select("patient_id", F.explode(F.array("from_label", "to_label")).alias("label")).distinct()
    found = cut_large(fuzzy_lookup(asked, targets, "ord"))  # read for both ends
    kinds = nodes.select("patient_id", "node_id", "kind")

    def end(side: str) -> DataFrame:
        return found.join(kinds, (found["patient_id"] == kinds["patient_id"]) & (found["target_id"] == kinds["node_id"])) \
            .select(found["patient_id"], F.col("label").alias(f"{side}_label"), F.col("node_id").alias(f"{side}_node"),
                    F.col("kind").alias(f"{side}_kind"))

    e = proposals.join(end("from"), ["patient_id", "from_label"]).join(end("to"), ["patient_id", "to_label"])
    e = valid_relations(e.filter(F.col("from_node") != F.col("to_node")), lex).withColumn("edge_id", edge_id())
    first = e.groupBy("patient_id", "edge_id").agg(F.min_by(
        F.struct("from_node", "to_node", "relation", "reason", "from_label", "to_label"), "pos").alias("r"))
    new = first.join(existing.select("patient_id", "edge_id"), ["patient_id", "edge_id"], "left_anti")
    return new.select("patient_id", "edge_id", "r.from_node", "r.to_node", "r.relation",
                      F.lit(PROPOSED_CONFIDENCE).alias("confidence"), F.lit("needs_review").alias("review_status"),
                      F.col("r.reason").alias("rationale"), "r.from_label", "r.to_label")


def proposed_edge_evidence(edges: DataFrame, node_events: DataFrame, events: DataFrame) -> DataFrame:
    """Events of both ends; an edge whose ends have none takes events whose label contains either label."""
    ends = edges.select("patient_id", "edge_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    direct = ends.join(node_events.select("patient_id", "node_id", "event_id"), ["patient_id", "node_id"]).select(
        "patient_id", "edge_id", "event_id").distinct()
    bare = edges.join(direct.select("patient_id", "edge_id").distinct(), ["patient_id", "edge_id"], "left_anti")
    asks = bare.select("patient_id", "edge_id", F.explode(F.array(F.lower("from_label"), F.lower("to_label"))).alias("q"))
    text = events.select("patient_id", "event_id", F.lower("label").alias("l"))
    labels = text.select("patient_id", "l").distinct()
    hits = _containing(asks, "q", labels, "l").distinct()
    loose = hits.join(text, ["patient_id", "l"]).select("patient_id", "edge_id", "event_id").distinct()
    return direct.unionByName(loose)


def extra_alerts(proposals: DataFrame, existing: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, evidence) from (patient_id, pos, title, severity, time_horizon, specialty, explanation,
    evidence_labels, questions): new titles only, the first two per patient, evidence required."""
    titles = existing.select("patient_id", F.lower("title").alias("_t")).distinct()
    p = proposals.filter(F.coalesce(F.col("title"), F.lit("")) != "").withColumn("_t", F.lower("title"))
    p = p.join(titles, ["patient_id", "_t"], "left_anti")
    w = W.partitionBy("patient_id").orderBy("pos")
    p = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= EXTRA_ALERTS)
    asks = p.select("patient_id", "pos", F.explode("evidence_labels").alias("label"))
    targets = events.select("patient_id", F.col("event_id").alias("target_id"), F.col("label").alias("text"), "seq")
    found = fuzzy_lookup(asks.select("patient_id", "label").distinct(), targets, "seq", exact_first=False)
    evidence = asks.join(found, ["patient_id", "label"]).select("patient_id", "pos", F.col("target_id").alias("event_id"))
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("medium")
    alerts = p.join(evidence.select("patient_id", "pos").distinct(), ["patient_id", "pos"], "left_semi").select(
        "patient_id", "pos", severity.alias("severity"), severity_rank(severity).alias("severity_rank"), "title",
        F.coalesce(F.nullif("time_horizon", F.lit("")), F.lit("Next 2 weeks")).alias("time_horizon"),
        F.coalesce("specialty", F.array(F.lit("primary care"))).alias("specialty"), "explanation",
        F.coalesce("questions", F.array().cast("array<string>")).alias("questions"))
    return alerts, evidence


def checked_trends(proposals: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trends, evidence): proposed trends with only evidence ids that exist; those left without any are
    dropped, unknown specialties are cleared."""
    ids = proposals.select("patient_id", "trend_id", F.posexplode("evidence_event_ids").alias("pos", "event_id"))
    evidence = ids.join(events.select("patient_id", "event_id"), ["patient_id", "event_id"], "left_semi")
    known = F.col("specialty").isin(*REPORT_SPECIALTIES)
    trends = proposals.join(evidence.select("patient_id", "trend_id").distinct(), ["patient_id", "trend_id"], "left_semi")
    return trends.select("patient_id", "trend_id", F.coalesce("metric", F.lit("Unknown")).alias("metric"),
                         F.coalesce("direction", F.lit("stable")).alias("direction"),
                         F.coalesce("severity", F.lit("low")).alias("severity"),
                         F.when(known, F.col("specialty")).alias("specialty"),
                         F.when(known, F.trim("reason")).alias("reason")), evidence


def trend_evidence(evidence: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Display rows of trend evidence: label, kind and source type (``event`` when the source is unknown)."""
    e = events.select("patient_id", "event_id", "label", "kind", "source_id")
    s = sources.select("patient_id", "source_id", "source_type")
    return (evidence.join(e, ["patient_id", "event_id"]).join(s, ["patient_id", "source_id"], "left")
            .select("patient_id", "trend_id", "pos", "event_id", "label", "kind",
                    F.coalesce("source_type", F.lit("event")).alias("source_type")))


def resolve_citations(citations: DataFrame, nodes: DataFrame, node_events: DataFrame, events: DataFrame) -> DataFrame:
    """One output row per citation (patient_id, answer_id, pos, node_id, event_id, note), positions kept.
    An event that several nodes hold belongs to the first of them in graph order (``ord``)."""
    n = nodes.select("patient_id", "node_id", F.col("label").alias("node_label"), F.col("kind").alias("node_kind"))
    e = events.select("patient_id", "event_id", F.col("label").alias("event_label"), "value", "unit", "observed_at",
                      F.col("kind").alias("event_kind"))
    owner = (node_events.join(nodes.select("patient_id", "node_id", "ord"), ["patient_id", "node_id"])
             .groupBy("patient_id", "event_id").agg(F.min_by("node_id", "ord").alias("owner_node")))
    j = (citations.join(n, ["patient_id", "node_id"], "left").join(e, ["patient_id", "event_id"], "left")
         .join(owner, ["patient_id", "event_id"], "left"))
    unit = F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat(F.lit(" "), "unit")).otherwise("")
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit(" "), "value", unit)).otherwise("")
    date = F.when(F.col("observed_at").isNotNull(), F.concat(F.lit(" · "), F.date_format("observed_at", "MMM yyyy"))).otherwise("")
    note = F.nullif(F.trim("note"), F.lit(""))
    has_event, has_node = F.col("event_label").isNotNull(), F.col("node_label").isNotNull()
    label = F.when(has_event, F.concat("event_label", value, date)).when(has_node, F.col("node_label"))
    return j.select("patient_id", "answer_id", "pos",
                    F.coalesce(F.nullif(label, F.lit("")), note, F.lit("Supporting record")).alias("label"),
                    F.when(has_node, F.col("node_kind")).when(has_event, F.col("event_kind")).alias("kind"),
                    F.when(has_node, F.col("node_id")).when(has_event, F.col("owner_node")).alias("node_id"),
                    F.when(has_event, F.col("event_id")).alias("event_id"), note.alias("detail"))


def split_answer(answers: DataFrame) -> DataFrame:
    """Text and ``[n]`` citation parts of an answer: (answer_id, part, type, value, citation)."""
    marker = r"\[[0-9]+\]"
    pieces = F.split("answer", rf"(?={marker})|(?<=\[[0-9]{{1,9}}\])")
    parts = F.filter(pieces, lambda p: p != "")
    is_cite = F.col("value").rlike(rf"^{marker}$")
    return answers.select("answer_id", F.posexplode(parts).alias("part", "value")).select(
        "answer_id", "part", F.when(is_cite, "cite").otherwise("text").alias("type"), "value",
        F.when(is_cite, F.regexp_extract("value", r"([0-9]+)", 1).cast("int")).alias("citation"))
