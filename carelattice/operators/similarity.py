"""Exact similarity join of short labels (token Jaccard or bigram Dice at a threshold) within a scope, such as a patient.

Pairs come from shared signatures, not from comparing everything with everything:
two sets whose overlap must reach ``o`` share at least ``m`` elements among their
first ``n - o + m`` elements in any common order (prefix filtering).  Signatures are made once per distinct
label; labels only meet under the same signature of the same scope, so what two patients have in common makes no
pair and no hot key.  Each distinct pair that meets is scored once with the exact measure; nothing is capped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.text import bigrams, multiset, similarity, word_tokens
from carelattice.session import cut_large, cut_lineage


def _ordered(elements: Column) -> Column:
    """The same elements in one order for all labels, that of a hash: common ones do not come first."""
    return F.transform(F.array_sort(F.transform(elements, lambda e: F.struct(F.xxhash64(e).alias("h"), e.alias("e")))), lambda s: s.e)


def _signatures(items: Column, share: float, width: int, tag: str) -> Column:
    """Signatures of one ordered set: single prefix elements, or pairs of them when ``width`` is 2."""
    n = F.size(items)
    need = F.ceil(n * share - 1e-9).cast("int")
    head = F.slice(items, 1, F.greatest(F.lit(1), F.least(n, n - need + width)))
    if width == 1:
        return F.transform(head, lambda e: F.concat(F.lit(tag), e))
    pairs = F.flatten(F.transform(head, lambda e, i: F.transform(
        F.slice(head, i + 2, n), lambda f: F.concat(F.lit(tag), F.least(e, f), F.lit("\u0001"), F.greatest(e, f)))))
    # a single-element set can only match an equal single-element set
    return F.when(n == 1, F.transform(items, lambda e: F.concat(F.lit(tag + "1"), e))).otherwise(pairs)


def label_signatures(labels: DataFrame, threshold: float) -> DataFrame:
    """(label, _sigs) for each distinct label: similar ones share one at least."""
    share = threshold / (2 - threshold)
    width = 2 if math.ceil(2 * share - 1e-9) >= 2 else 1
    grams = _ordered(multiset(bigrams(F.col("label"))))
    words = _ordered(F.array_distinct(word_tokens(F.col("label"))))
    # written, since Spark moves conditions on the signatures below the distinct and would make them for every row
    feats = cut_lineage(labels.select("label").distinct()).select("label", grams.alias("_g"), words.alias("_t"))
    by_grams = F.when(F.size("_g") > 0, _signatures(F.col("_g"), share, width, "g"))
    by_words = F.when(F.size("_t") > 0, _signatures(F.col("_t"), threshold, width, "t"))
    if width == 2:
        # sets of at most n tokens reach the threshold only when equal, larger ones by prefix pairs
        n = _equal_only(threshold)
        whole = F.array(F.concat(F.lit("t="), F.array_join(F.col("_t"), "\u0001")))
        by_words = F.when(F.size("_t") == 0, None).when(F.size("_t") <= n, whole).otherwise(by_words)
    none = F.array().cast("array<string>")
    return feats.select("label", F.array_distinct(F.concat(F.coalesce(by_grams, none), F.coalesce(by_words, none))).alias("_sigs"))


def similar_pairs(labels: DataFrame, threshold: float, scope: tuple[str, ...] = ("block",)) -> DataFrame:
    """(scope..., a, b, score) for pairs of labels of one scope with similarity >= threshold.

    ``labels`` has distinct rows (scope..., label, left, right); a pair needs a on the left
    side, b on the right side and a != b.  Where both labels are on both sides the pair
    appears once (a < b).
    """
    # a signature of one label alone makes no pair; hashes that clash only propose pairs, which are scored exactly
    own = cut_lineage(label_signatures(labels, threshold).select("label", F.explode("_sigs").alias("_sig")).select("label", F.xxhash64("_sig").alias("_sig")))
    shared = own.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sig")
    kept = cut_lineage(own.join(shared, "_sig").groupBy("label").agg(F.collect_list("_sig").alias("_sigs")))
    # read by both sides of the join
    sig = cut_large(labels.join(kept, "label").select(*scope, "label", "left", "right", F.explode("_sigs").alias("_sig")))
    a = sig.filter("left").select(*scope, "_sig", F.col("label").alias("a"), F.col("right").alias("_ra"))
    b = sig.filter("right").select(*scope, "_sig", F.col("label").alias("b"), F.col("left").alias("_lb"))
    met = a.join(b, [*scope, "_sig"]).filter(
        (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~(F.col("_ra") & F.col("_lb"))))
    met = cut_large(met.select(*scope, "a", "b").distinct())
    # written, since Spark moves the filter below the distinct and would score a pair once for each scope
    scored = cut_lineage(met.select("a", "b").distinct()).withColumn("score", similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    return met.join(scored, ["a", "b"]).select(*scope, "a", "b", "score")


def _equal_only(threshold: float) -> int:
    """Largest n such that token sets of size n and n + 1 cannot reach the threshold."""
    n = 1
    while (n + 1) / (n + 2) < threshold:
        n += 1
    return n
