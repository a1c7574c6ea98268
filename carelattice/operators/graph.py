"""Property graph: assembly, evidence subgraphs, neighbourhoods, filters and counts.

A graph is four tables keyed by patient: nodes, edges, and their evidence in long form
(node_events, edge_evidence).  Traversals take many queries at once and are fixed
pipelines of equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carelattice.session import cut_lineage

PATIENT_NODE = "node_patient"

# --- fixed values -----------------------------------------------------------
NODE_OF_KIND = {"condition": "condition", "symptom": "symptom", "medication": "medication", "lab": "lab", "vital": "lab",
                "encounter": "encounter", "care_task": "task", "barrier": "barrier"}
RELATION_OF_KIND = {"condition": "has_condition", "symptom": "reported", "medication": "takes", "lab": "ordered",
                    "vital": "ordered", "care_task": "needs_follow_up", "barrier": "barrier_to"}
CLUSTER_OF_NODE = {"patient": "person", "condition": "clinical", "risk": "clinical", "symptom": "signals", "lab": "signals",
                   "encounter": "context", "medication": "treatment", "task": "treatment", "barrier": "context",
                   "conversation": "context", "source": "evidence"}
RELATION_PHRASES = {
    "has_condition": "has condition", "takes": "takes", "reported": "reported", "ordered": "ordered",
    "managed_by": "is managed by", "worsening_trend": "shows a worsening trend in",
    "risk_factor_for": "is a risk factor for", "contraindicated_with": "is contraindicated with",
    "needs_follow_up": "needs follow-up on", "barrier_to": "is a barrier to",
    "possibly_related_to": "is possibly related to"}
REASONING_RELATIONS = ("risk_factor_for", "worsening_trend", "contraindicated_with", "possibly_related_to", "managed_by",
                       "needs_follow_up", "barrier_to")
SEARCH_LIMIT, EXPLAIN_LIMIT, NEARBY_LIMIT, VISIBLE_CONFIDENCE = 8, 12, 8, 0.5
# --- end of fixed values ----------------------------------------------------


def lookup(c: Column, table: dict[str, str], default: str | Column) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def node_kind(kind: Column) -> Column:
    return lookup(kind, NODE_OF_KIND, "encounter")


def patient_relation(kind: Column) -> Column:
    return lookup(kind, RELATION_OF_KIND, "belongs_to_visit")


def node_cluster(kind: Column) -> Column:
    return lookup(kind, CLUSTER_OF_NODE, "context")


def relation_phrase(relation: Column) -> Column:
    return lookup(relation, RELATION_PHRASES, F.replace(relation, F.lit("_"), F.lit(" ")))


@dataclass
class Graph:
    nodes: DataFrame          # patient_id, node_id, kind, label, confidence, review_status, latest_value, unit
    node_events: DataFrame    # patient_id, node_id, event_id, seq
    edges: DataFrame          # patient_id, edge_id, from_node, to_node, relation, confidence, review_status
    edge_evidence: DataFrame  # patient_id, edge_id, event_id


def edge_id() -> Column:
    return F.concat_ws("|", "from_node", "to_node", "relation")


def latest_fact(members: DataFrame) -> DataFrame:
    """Newest fact per entity; among equal times the first in entity order."""
    order = F.struct((-F.unix_micros("observed_at")).alias("t"), "cluster_seq", "seq")
    return members.groupBy("patient_id", "entity_key").agg(
        F.min_by(F.struct("value", "unit"), order).alias("latest")).select(
        "patient_id", "entity_key", F.col("latest.value").alias("latest_value"), F.col("latest.unit").alias("unit"))


def entity_label(kind: Column, label: Column, value: Column, unit: Column) -> Column:
    suffix = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")
    return F.when((kind == "lab") & value.isNotNull(), F.concat(label, F.lit(": "), value, suffix)).otherwise(label)


def build(patients: DataFrame, sources: DataFrame, entities: DataFrame, members: DataFrame,
          relationships: DataFrame, contexts: DataFrame | None = None,
          context_events: DataFrame | None = None) -> Graph:
    """Patient, source, entity and conversation nodes with patient, provenance, relationship and
    conversation edges.  ``patients`` has patient_id and name.  ``ord`` of a node is its place in the patient's graph: patient,
    sources, entities as they first came up, conversations."""
    none, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    node = ["patient_id", "node_id", "kind", "label", "confidence", "review_status", "latest_value", "unit", "ord"]
    arrival = F.lit(None).cast(entities.schema["first_seq"].dataType)

    def nodes_of(df, family, node_id, kind, label, confidence=num, review=none, latest=none, unit=none, first_seq=arrival):
        order = F.struct(F.lit(family).alias("family"), first_seq.alias("first_seq"), node_id.alias("node_id"))
        return df.select("patient_id", node_id.alias("node_id"), kind.alias("kind"), label.alias("label"),
                         confidence.alias("confidence"), review.alias("review_status"), latest.alias("latest_value"),
                         unit.alias("unit"), order.alias("ord"))

    def edges_of(df, source, target, relation, confidence=num, review=none):
        return df.select("patient_id", source.alias("from_node"), target.alias("to_node"), relation.alias("relation"),
                         confidence.alias("confidence"), review.alias("review_status"))

    src = sources.select("patient_id", "source_id", F.concat(F.lit("node_src_"), "source_id").alias("src_node"), "title")
    e = entities.join(latest_fact(members), ["patient_id", "entity_key"])
    nodes = nodes_of(patients, 0, F.lit(PATIENT_NODE), F.lit("patient"), F.col("name"))
    nodes = nodes.unionByName(nodes_of(src, 1, F.col("src_node"), F.lit("source"), F.col("title")))
    nodes = nodes.unionByName(nodes_of(
        e, 2, F.col("entity_key"), F.col("kind"),
        entity_label(F.col("kind"), F.col("canonical_label"), F.col("latest_value"), F.col("unit")), F.col("confidence"),
        F.col("review_status"), F.col("latest_value"), F.col("unit"), F.col("first_seq")))
    node_events = members.select("patient_id", F.col("entity_key").alias("node_id"), "event_id", "seq")

    patient_edges = edges_of(e, F.lit(PATIENT_NODE), F.col("entity_key"), patient_relation(F.col("first_kind")),
                             F.col("confidence"), F.col("review_status"))
    mentions = (members.select("patient_id", "entity_key", "source_id").distinct().join(src, ["patient_id", "source_id"]))
    mention_edges = edges_of(mentions, F.col("entity_key"), F.col("src_node"), F.lit("mentioned_in"), F.lit(1.0),
                             F.lit("accepted"))
    rel_edges = edges_of(relationships, F.col("from_key"), F.col("to_key"), F.col("relation"), F.col("confidence"),
                         F.col("review_status"))
    edges = patient_edges.unionByName(mention_edges).unionByName(rel_edges)

    kind_of = entities.select("patient_id", "entity_key", patient_relation(F.col("first_kind")).alias("relation"))
    m = members.select("patient_id", "entity_key", "source_id", "event_id")
    on_patient = m.join(kind_of, ["patient_id", "entity_key"]).select(
        "patient_id", F.concat_ws("|", F.lit(PATIENT_NODE), "entity_key", "relation").alias("edge_id"), "event_id")
    on_mention = m.join(src.select("patient_id", "source_id", "src_node"), ["patient_id", "source_id"]).select(
        "patient_id", F.concat_ws("|", "entity_key", "src_node", F.lit("mentioned_in")).alias("edge_id"), "event_id")
    ends = relationships.select("patient_id", F.concat_ws("|", "from_key", "to_key", "relation").alias("edge_id"),
                                F.explode(F.array("from_key", "to_key")).alias("entity_key"))
    on_relation = ends.join(m, ["patient_id", "entity_key"]).select("patient_id", "edge_id", "event_id")
    evidence = on_patient.unionByName(on_mention).unionByName(on_relation)

    if contexts is not None:
        c_nodes, c_edges, c_evidence, c_events = conversation_parts(contexts, context_events, src, node_events, nodes)
        nodes = nodes.unionByName(nodes_of(c_nodes, 3, F.col("node_id"), F.lit("conversation"), F.col("label")))
        edges = edges.unionByName(edges_of(c_edges, F.col("from_node"), F.col("to_node"), F.col("relation")))
        evidence = evidence.unionByName(c_evidence)
        node_events = node_events.unionByName(c_events)
    return Graph(nodes.select(*node), node_events, edges.withColumn("edge_id", edge_id()), evidence)


def linked_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships, such as stored or foreign ones, both of whose ends are entities of the patient."""
    keys = entities.select("patient_id", "entity_key")
    ends = relationships.join(keys.withColumnRenamed("entity_key", "from_key"), ["patient_id", "from_key"], "left_semi")
    return ends.join(keys.withColumnRenamed("entity_key", "to_key"), ["patient_id", "to_key"], "left_semi").select(*relationships.columns)


def conversation_parts(contexts: DataFrame, context_events: DataFrame, sources: DataFrame, node_events: DataFrame, nodes: DataFrame):
    """Hub node per conversation: reported by the patient, mentioned in its source, possibly related
    to the node of each of its events (each node once, witnessed by its first event)."""
    hub = contexts.select(
        "patient_id", "context_id", "source_id", F.concat(F.lit("node_ctx_"), "context_id").alias("node_id"),
        F.when(F.coalesce(F.col("chief_concern"), F.lit("")) != "", F.col("chief_concern")).otherwise(F.col("title"))
        .alias("label"))
    ce = context_events.join(hub.select("patient_id", "context_id", "node_id"), ["patient_id", "context_id"])
    reported = hub.select("patient_id", F.lit(PATIENT_NODE).alias("from_node"), F.col("node_id").alias("to_node"),
                          F.lit("reported").alias("relation"))
    mention = hub.join(sources, ["patient_id", "source_id"]).select(
        "patient_id", F.col("node_id").alias("from_node"), F.col("src_node").alias("to_node"),
        F.lit("mentioned_in").alias("relation"))
    # an event held by several nodes belongs to the one added last
    owner = (node_events.join(nodes.select("patient_id", "node_id", "ord"), ["patient_id", "node_id"])
             .groupBy("patient_id", "event_id").agg(F.max_by("node_id", "ord").alias("entity_node")))
    linked = (ce.join(owner, ["patient_id", "event_id"]).groupBy("patient_id", "node_id", "entity_node")
              .agg(F.min_by("event_id", "seq").alias("event_id")))
    related = linked.select("patient_id", F.col("node_id").alias("from_node"), F.col("entity_node").alias("to_node"),
                            F.lit("possibly_related_to").alias("relation"))
    edges = reported.unionByName(mention).unionByName(related)
    hub_edges = reported.unionByName(mention).withColumn("edge_id", edge_id()).withColumn(
        "node_id", F.when(F.col("relation") == "reported", F.col("to_node")).otherwise(F.col("from_node")))
    evidence = (hub_edges.select("patient_id", "edge_id", "node_id").join(
        ce.select("patient_id", "node_id", "event_id"), ["patient_id", "node_id"]).select("patient_id", "edge_id", "event_id")
        .unionByName(linked.select("patient_id", F.concat_ws("|", "node_id", "entity_node", F.lit("possibly_related_to"))
                                   .alias("edge_id"), "event_id")))
    return hub, edges, evidence, ce.select("patient_id", "node_id", "event_id", "seq")


# -- traversal ---------------------------------------------------------------------------------

def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("patient_id", "query_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))


def evidence_subgraph(g: Graph, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query (patient_id, query_id, event_id rows): nodes and edges that explain its events.

    Seeds share an event with the query; one hop follows clinical edges only (no provenance, no
    patient hub); the patient node and its edges to kept nodes are added back.
    """
    f = focus.select("patient_id", "query_id", "event_id").distinct()
    e = g.edges.select("patient_id", "edge_id", "from_node", "to_node", "relation")
    hit_ids = g.edge_evidence.join(f, ["patient_id", "event_id"]).select("patient_id", "query_id", "edge_id").distinct()
    hit_edges = cut_lineage(hit_ids.join(e, ["patient_id", "edge_id"]))
    seeds = g.node_events.join(f, ["patient_id", "event_id"]).select("patient_id", "query_id", "node_id")
    start = cut_lineage(seeds.unionByName(_ends(hit_edges)).distinct())
    clinical = e.filter((F.col("relation") != "mentioned_in") & (F.col("from_node") != PATIENT_NODE)
                        & (F.col("to_node") != PATIENT_NODE))
    hop = (clinical.join(start.withColumnRenamed("node_id", "from_node"), ["patient_id", "from_node"])
           .unionByName(clinical.join(start.withColumnRenamed("node_id", "to_node"), ["patient_id", "to_node"])))
    hop = cut_lineage(hop.select("patient_id", "query_id", "edge_id", "from_node", "to_node", "relation"))
    kept = start.unionByName(_ends(hop)).distinct()
    hub = (e.filter(F.col("from_node") == PATIENT_NODE)
           .join(kept.withColumnRenamed("node_id", "to_node"), ["patient_id", "to_node"]))
    cols = ["patient_id", "query_id", "edge_id", "from_node", "to_node", "relation"]
    edges = hit_edges.select(*cols).unionByName(hop.select(*cols)).unionByName(hub.select(*cols)).distinct()
    queries = kept.select("patient_id", "query_id").distinct()
    node_ids = kept.unionByName(queries.withColumn("node_id", F.lit(PATIENT_NODE))).distinct()
    nodes = node_ids.join(g.nodes, ["patient_id", "node_id"])
    return nodes, edges


def one_hop(g: Graph, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (patient_id, query_id, node_id): the node, its neighbours and the edges among them."""
    c = centers.select("patient_id", "query_id", "node_id")
    e = g.edges.select("patient_id", "edge_id", "from_node", "to_node", "relation")
    out = c.join(e.withColumnRenamed("from_node", "node_id"), ["patient_id", "node_id"]).select(
        "patient_id", "query_id", F.col("to_node").alias("node_id"))
    inc = c.join(e.withColumnRenamed("to_node", "node_id"), ["patient_id", "node_id"]).select(
        "patient_id", "query_id", F.col("from_node").alias("node_id"))
    ids = cut_lineage(c.unionByName(out).unionByName(inc).distinct())
    edges = (ids.withColumnRenamed("node_id", "from_node").join(e, ["patient_id", "from_node"])
             .join(ids.withColumnRenamed("node_id", "to_node"), ["patient_id", "query_id", "to_node"], "left_semi"))
    return ids.join(g.nodes, ["patient_id", "node_id"]), edges


def query_graph(g: Graph, alert_events: DataFrame | None = None, centers: DataFrame | None = None,
                search_hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dispatch: alert evidence, else a node, else event search hits, else the whole graph."""
    if alert_events is not None:
        return evidence_subgraph(g, alert_events)
    if centers is not None:
        return one_hop(g, centers)
    if search_hits is not None:
        return evidence_subgraph(g, search_hits.filter(F.col("event_id").isNotNull()))
    return g.nodes, g.edges


def focus_events(g: Graph, alert_events: DataFrame | None = None, centers: DataFrame | None = None,
                 search_hits: DataFrame | None = None) -> DataFrame:
    """Event ids a query highlights: union of its alert, node and search evidence."""
    parts = [d.select("patient_id", "query_id", "event_id") for d in (alert_events, search_hits) if d is not None]
    if centers is not None:
        parts.append(centers.join(g.node_events, ["patient_id", "node_id"]).select("patient_id", "query_id", "event_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("event_id").isNotNull()).distinct()


def neighbors(g: Graph, centers: DataFrame | None = None) -> DataFrame:
    """Edges of a node seen from it: direction, other end, confidence; mentions only toward sources."""
    e, n = g.edges, g.nodes.select("patient_id", F.col("node_id").alias("neighbor_id"), F.col("label").alias("neighbor_label"),
                                   F.col("kind").alias("neighbor_kind"))

    def seen(a: str, b: str, direction: str, rows: DataFrame) -> DataFrame:
        return rows.select("patient_id", F.col(a).alias("node_id"), "edge_id", "relation", F.lit(direction).alias("direction"),
                           F.col(b).alias("neighbor_id"), "confidence")

    both = seen("from_node", "to_node", "outgoing", e).unionByName(
        seen("to_node", "from_node", "incoming", e.filter(F.col("from_node") != F.col("to_node"))))
    if centers is not None:
        both = both.join(centers.select("patient_id", "node_id").distinct(), ["patient_id", "node_id"], "left_semi")
    out = both.join(n, ["patient_id", "neighbor_id"], "left").withColumn(
        "neighbor_label", F.coalesce("neighbor_label", "neighbor_id"))
    return out.filter((F.col("relation") != "mentioned_in") | (F.col("neighbor_kind") == "source"))


def nearby(g: Graph, centers: DataFrame, limit: int = NEARBY_LIMIT) -> DataFrame:
    """First edges of a node, in edge-id order."""
    w = W.partitionBy("patient_id", "node_id").orderBy("edge_id")
    return neighbors(g, centers).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def events_of_nodes(g: Graph, events: DataFrame, centers: DataFrame) -> DataFrame:
    ids = centers.select("patient_id", "node_id").distinct().join(g.node_events.drop("seq"), ["patient_id", "node_id"])
    return ids.join(events, ["patient_id", "event_id"])


# -- filters and search ------------------------------------------------------------------------

def graph_tokens(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def match_score(haystack: Column, query: Column) -> Column:
    low = F.lower(haystack)
    return F.size(F.filter(graph_tokens(query), lambda t: F.contains(low, t)))


def haystacks(g: Graph, aliases: DataFrame | None, topics: DataFrame | None = None) -> DataFrame:
    """Searchable strings of a node in long form (label, kind, one row per alias or topic)."""
    own = g.nodes.select("patient_id", "node_id", F.concat_ws(" ", "label", "kind").alias("text"))
    if aliases is not None:
        own = own.unionByName(aliases.select("patient_id", F.col("entity_key").alias("node_id"), F.col("alias").alias("text")))
    if topics is not None:
        own = own.unionByName(topics.select("patient_id", "node_id", F.col("topic").alias("text")))
    return own


def search_graph(g: Graph, aliases: DataFrame | None, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Top nodes per patient by the number of query tokens found in label, kind or an alias.
    Sources are skipped; a query without tokens keeps every node."""
    import re

    q = F.lit(query)
    tokens = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if len(t) > 2]
    found = haystacks(g, aliases).select("patient_id", "node_id", *[
        F.contains(F.lower("text"), F.lit(t)).alias(f"_t{i}") for i, t in enumerate(tokens)])
    score = sum((F.max(F.col(f"_t{i}").cast("int")) for i in range(len(tokens))), F.lit(0))
    scored = found.groupBy("patient_id", "node_id").agg(score.alias("score"))
    hits = g.nodes.filter(F.col("kind") != "source").join(scored, ["patient_id", "node_id"])
    if tokens:
        hits = hits.filter(F.col("score") > 0)
    w = W.partitionBy("patient_id").orderBy(F.col("score").desc(), "node_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def text_matches(g: Graph, aliases: DataFrame | None, query: str, topics: DataFrame | None = None) -> DataFrame:
    """Ids of nodes whose label, kind, alias or topic contains the text; a blank text matches all."""
    q = query.strip().lower()
    if not q:
        return g.nodes.select("patient_id", "node_id")
    return haystacks(g, aliases, topics).filter(F.contains(F.lower("text"), F.lit(q))).select("patient_id", "node_id").distinct()


def expanded_search(g: Graph, matches: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Matched nodes plus their neighbours, plus an expanded node with its neighbours."""
    centers = matches.select("patient_id", "node_id")
    if expanded is not None:
        centers = centers.unionByName(expanded.select("patient_id", "node_id"))
    e = g.edges.select("patient_id", "from_node", "to_node")
    out = centers.join(e.withColumnRenamed("from_node", "node_id"), ["patient_id", "node_id"]).select(
        "patient_id", F.col("to_node").alias("node_id"))
    inc = centers.join(e.withColumnRenamed("to_node", "node_id"), ["patient_id", "node_id"]).select(
        "patient_id", F.col("from_node").alias("node_id"))
    return centers.unionByName(out).unionByName(inc).distinct()


def visible_edges(g: Graph, kept_nodes: DataFrame | None = None, disabled: tuple[str, ...] = (),
                  selected: str | None = None) -> DataFrame:
    """Edges between kept nodes, without switched-off relations and weak edges (unless selected)."""
    e = g.edges
    if disabled:
        e = e.filter(~F.col("relation").isin(*disabled))
    if kept_nodes is not None:
        k = kept_nodes.select("patient_id", "node_id")
        e = e.join(k.withColumnRenamed("node_id", "from_node"), ["patient_id", "from_node"], "left_semi")
        e = e.join(k.withColumnRenamed("node_id", "to_node"), ["patient_id", "to_node"], "left_semi")
    keep = (F.col("relation") == "mentioned_in") | F.col("confidence").isNull() | (F.col("confidence") >= VISIBLE_CONFIDENCE)
    if selected is not None:
        keep = keep | (F.col("from_node") == selected) | (F.col("to_node") == selected)
    return e.filter(keep)


def graph_counts(g: Graph) -> DataFrame:
    n = g.nodes.groupBy("patient_id").agg(F.count(F.lit(1)).alias("nodes"),
                                          F.count_distinct(node_cluster(F.col("kind"))).alias("clusters"))
    e = g.edges.groupBy("patient_id").agg(F.count_if(F.col("relation") != "mentioned_in").alias("edges"),
                                          F.count_distinct("relation").alias("relations"))
    return n.join(e, "patient_id", "left").fillna(0, ["edges", "relations"])


def cluster_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("patient_id", node_cluster(F.col("kind")).alias("cluster")).agg(F.count(F.lit(1)).alias("nodes"))


def explain_relationships(relationships: DataFrame, query: str = "", limit: int = EXPLAIN_LIMIT) -> DataFrame:
    """Per patient the first relationships: reasoning relations before others, then confidence."""
    labels = F.concat_ws(" ", "from_label", "to_label")
    tokens = F.size(graph_tokens(F.lit(query)))
    score = F.when(tokens == 0, F.lit(1)).otherwise(match_score(labels, F.lit(query)))
    r = relationships.withColumn("score", score).filter(F.col("score") > 0).withColumn(
        "phrase", F.concat_ws(" ", F.col("from_label"), relation_phrase(F.col("relation")), F.col("to_label")))
    w = W.partitionBy("patient_id").orderBy(F.col("relation").isin(*REASONING_RELATIONS).desc(), F.col("confidence").desc(),
                                            "family", "from_seq", "rule_no", "to_seq", "from_key", "to_key")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
