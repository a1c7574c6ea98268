"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm import audio, exacthash, hardneg, lines, maxscore, mixing, packing, prefixtrie, rules, secrets, simhash, simple8b, toxicity
from carelattice.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` as melodies; every recording with an id divisible by 50 is searched among all."""
    prints = cut_lineage(audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.melody))
    return audio.search(prints, F.col("recording") % 50 == 0)


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = simple8b.fresh_path(spark)
    simple8b.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return simple8b.read(spark, path)


def op4_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), rules.held_out(F.col("doc_id"), 5, 0)
    model = rules.train(docs, table(spark, sf_dir, "labels").where(~out), "quality")
    return rules.score(rules.statistics(docs), model, 0.3).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = rules.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs.where(~out), table(spark, sf_dir, "labels").where(~out), "toxic")
    return toxicity.score(docs, model, 0.7).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(maxscore.quantised(table(spark, sf_dir, "embeddings"), 1024))
    return maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.domain_labels(table(spark, sf_dir, "labels")), weights=[0.94, 0.04, 0.02])
    return mixed.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)), "rate", "copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with the first turns of the one its number is rounded down to a multiple of five to."""
    conv = F.col("conv")
    told, members = prefixtrie.spliced(prefixtrie.turns(table(spark, sf_dir, "conversations")), base=conv - F.pmod(conv, F.lit(5)),
                                       head=F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    return prefixtrie.trie(told, members)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut_lineage(hardneg.quantised(table(spark, sf_dir, "embeddings"), 256, label))
    mined = hardneg.mine(rows, rows.where("vec_id % 50 = 0"), positive=5, negative=3, low=50, high=95)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exacthash.copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_chroma_alignment, op3_simple8b, op4_log_template_lines, op5_simhash_components, op6_quality_rules, op7_toxicity_pu, op8_maxscore_topk, op9_soft_mixing, op10_secret_scan,
                                 op11_prefix_trie, op12_hard_negatives, op13_exact_dedup)}
ORACLES: dict[str, str] = {"op4_log_template_lines": lines.SQL, "op8_maxscore_topk": maxscore.SQL, "op11_prefix_trie": prefixtrie.SQL,
                           "op12_hard_negatives": hardneg.SQL, "op13_exact_dedup": exacthash.SQL}
