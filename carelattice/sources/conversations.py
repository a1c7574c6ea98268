"""Conversations (conv_id, turn, role, text): filtering, transcripts, context and events.

A conversation may be arbitrarily long.  Keyword flags are boolean aggregates, text prefixes
need only the first turns, and phrases that can straddle turns are checked against the
next turns inside bounded buckets of turns; no conversation is gathered into one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carelattice.functions.text import is_blank, js_trim
from carelattice.sources.transcripts import KEYWORD_RULES, rule_hits

# --- fixed values -----------------------------------------------------------
CONTEXT_RULES = {
    "symptoms": [("tired|fatigue|exhausted", "Fatigue"), ("swelling|edema", "Swelling"),
                 ("shortness of breath|breathless", "Shortness of breath")],
    "medications": [("ibuprofen|advil|motrin|nsaid", "NSAID use"), ("lisinopril", "Lisinopril")],
    "barriers": [("missed|appointment", "Missed appointment"), ("insurance", "Insurance issue"),
                 ("refill|pharmacy", "Medication refill issue")],
}
TOPIC_PREFIX = {"symptoms": "symptom: ", "medications": "medication: ", "barriers": "barrier: "}
TITLE = "Conversation"
NO_CONCERN = "Patient-reported health update"
NO_SUMMARY = "Patient shared symptoms, medications, and care context."
SUMMARY_LENGTH, CONCERN_LENGTH, HISTORY_TURNS = 280, 80, 8
FOLLOW_UPS = 5  # fixed value: follow-up items of a conversation
# --- end of fixed values ----------------------------------------------------

TURN_BUCKET = 4096
# Phrases of several words that a rule looks for: they may begin in one turn and end in a later one.
PHRASES = sorted({alt for p in [p for p, *_ in KEYWORD_RULES] + [p for rules in CONTEXT_RULES.values() for p, _ in rules]
                  for alt in p.split("|") if " " in alt})
HEAD = max(map(len, PHRASES), default=0)
AHEAD = max((len(p.split(" ")) - 1 for p in PHRASES), default=0)  # every turn adds a word at least


def valid_messages(messages: DataFrame) -> DataFrame:
    """Non-blank user and assistant turns of conversations with at least one user turn."""
    m = messages.filter(F.col("role").isin("user", "assistant") & ~is_blank(F.col("text")))
    spoken = m.filter(F.col("role") == "user").select("conv_id").distinct()
    return m.join(spoken, "conv_id", "left_semi")


def transcript_lines(messages: DataFrame) -> DataFrame:
    """One line per turn; the transcript is the lines in turn order joined by blank lines."""
    who = F.when(F.col("role") == "assistant", "Assistant").otherwise("Patient")
    return messages.select("conv_id", "turn", F.concat(who, F.lit(": "), F.col("text")).alias("line"))


def history_tail(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    m = messages.filter(F.col("role").isin("user", "assistant") & ~is_blank(F.col("text")))
    return m.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= turns).drop("_r")


def _following(user: DataFrame) -> DataFrame:
    """Adds ``next``: the start of the user text after this turn, from as many turns as the longest phrase can touch.
    Buckets bound every window; the edge of a bucket continues into the next ones."""
    head = F.substring(F.lower("text"), 1, HEAD)
    u = user.select("conv_id", "turn", F.lower("text").alias("low"), head.alias("head"),
                    F.floor(F.col("turn") / TURN_BUCKET).alias("bucket"))
    w = W.partitionBy("conv_id", "bucket").orderBy("turn")
    ahead = [f"n{k}" for k in range(1, AHEAD + 1)]
    u = u.withColumns({n: F.lead("head", k).over(w) for k, n in enumerate(ahead, 1)})
    first = (u.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= AHEAD)
             .groupBy("conv_id", "bucket").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("_r", "head"))), lambda s: s["head"]), " ").alias("start")))
    wb = W.partitionBy("conv_id").orderBy("bucket")
    later = first.select("conv_id", "bucket", F.concat_ws(" ", *(F.lead("start", k).over(wb) for k in range(1, AHEAD + 1))).alias("after"))
    edge = u.filter(F.col(ahead[-1]).isNull()).join(later, ["conv_id", "bucket"]).select(
        "conv_id", "low", F.concat_ws(" ", *ahead, "after").alias("next"))
    inner = u.filter(F.col(ahead[-1]).isNotNull()).select("conv_id", "low", F.concat_ws(" ", *ahead).alias("next"))
    return inner.unionByName(edge)


def user_flags(user: DataFrame, patterns: list[str]) -> DataFrame:
    """Per conversation, whether each pattern matches the user turns joined by single spaces."""
    flat = user.select("conv_id", F.lower("text").alias("low"))
    per_turn = [F.max(F.col("low").rlike(p)).alias(f"f{i}") for i, p in enumerate(patterns)]
    flags = flat.groupBy("conv_id").agg(*per_turn)
    if not PHRASES:
        return flags

    def cut(phrase: str) -> Column:
        """A turn ends with the phrase's first words and the text after it goes on with the rest."""
        words = phrase.split(" ")
        return functools.reduce(lambda a, b: a | b, (
            F.endswith(F.col("low"), F.lit(" ".join(words[:n]))) & F.startswith(F.col("next"), F.lit(" ".join(words[n:]))) for n in range(1, len(words))))

    spans = _following(user).groupBy("conv_id").agg(*(F.max(cut(p)).alias(f"_span{i}") for i, p in enumerate(PHRASES)))
    flags = flags.join(spans, "conv_id", "left")
    for i, pattern in enumerate(patterns):
        for j, phrase in enumerate(PHRASES):
            if phrase in pattern.split("|"):
                flags = flags.withColumn(f"f{i}", F.col(f"f{i}") | F.coalesce(f"_span{j}", F.lit(False)))
    return flags.drop(*(f"_span{j}" for j in range(len(PHRASES))))


def user_prefix(user: DataFrame, length: int) -> DataFrame:
    """First ``length`` characters of the joined user text.  Each turn adds at least one character, so the
    first ``length`` turns, each cut to ``length``, are enough whatever the conversation's size."""
    w = W.partitionBy("conv_id").orderBy("turn")
    firsts = user.select("conv_id", "turn", F.substring("text", 1, length).alias("t")) \
                 .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= length)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "t"))), lambda s: s["t"]), " ")
    return firsts.groupBy("conv_id").agg(F.substring(joined, 1, length).alias("prefix"))


def conversation_events(messages: DataFrame) -> DataFrame:
    """Keyword events of the folded user text (one row per fired rule, else one note)."""
    user = messages.filter(F.col("role") == "user")
    flags = user_flags(user, [p for p, *_ in KEYWORD_RULES])
    base = flags.join(user_prefix(user, SUMMARY_LENGTH), "conv_id")
    hits = rule_hits([F.col(f"f{i}") for i in range(len(KEYWORD_RULES))], F.col("prefix"))
    return base.select("conv_id", F.inline(hits)).select(
        F.concat_ws("_", F.lit("evt"), F.col("conv_id").cast("string"), F.col("rule").cast("string")).alias("event_id"),
        "conv_id", "rule", "kind", "label", "value", "status")


def conversation_context(messages: DataFrame) -> DataFrame:
    """Structured summary per conversation; all lists are bounded by the rule tables."""
    user = messages.filter(F.col("role") == "user")
    patterns = [p for rules in CONTEXT_RULES.values() for p, _ in rules]
    labels = [(group, label) for group, rules in CONTEXT_RULES.items() for _, label in rules]
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    base = user_flags(user, patterns).join(user_prefix(user, SUMMARY_LENGTH), "conv_id").join(counts, "conv_id")

    def fired(group: str) -> Column:
        return F.filter(F.array(*[F.when(F.col(f"f{i}"), F.lit(label)) for i, (g, label) in enumerate(labels) if g == group]),
                        lambda x: x.isNotNull())

    lists = base.select("conv_id", "message_count", "prefix", *[fired(g).alias(g) for g in CONTEXT_RULES])
    def tagged(group: str) -> Column:
        return F.transform(group, lambda x: F.concat(F.lit(TOPIC_PREFIX[group]), x))

    topics = F.concat(*[tagged(g) for g in CONTEXT_RULES])
    concern = F.coalesce(F.get("symptoms", F.lit(0)), F.get("barriers", F.lit(0)),
                         F.nullif(js_trim(F.substring("prefix", 1, CONCERN_LENGTH)), F.lit("")), F.lit(NO_CONCERN))
    return lists.select("conv_id", F.lit(TITLE).alias("title"), F.coalesce(F.nullif(js_trim(F.col("prefix")), F.lit("")), F.lit(NO_SUMMARY)).alias("summary"),
                        concern.alias("chief_concern"), topics.alias("topics"), *CONTEXT_RULES, "message_count")


def follow_up_items(events: DataFrame, group: list[str], order: str = "seq", limit: int = FOLLOW_UPS) -> DataFrame:
    """(group..., rank, label): the first care tasks of each conversation, in order; Spark limits them before the shuffle."""
    w = W.partitionBy(*group).orderBy(order)
    tasks = events.filter(F.col("kind") == "care_task").select(*group, order, "label").withColumn("rank", F.row_number().over(w))
    return tasks.filter(F.col("rank") <= limit).select(*group, "rank", "label")
