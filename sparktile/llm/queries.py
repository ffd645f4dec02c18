"""The thin queries over the operators of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, katz, language, link_graph, near_dedup, ngram_logistic, packing, pii, rule_ensemble, transcripts
from .common import fold, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rule_ensemble.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_logistic.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op6_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = transcripts.recover(table(spark, sf_dir, "conversations"), fold("conv_id", 5) != 0)
    turn = transcripts.rendered(F.col("role_pred"), F.col("text"))
    return said.select(F.col("conv").alias("conv_id"), "turn", (fold("conv", 5) == 0).alias("held_out"), "role_pred", F.length(turn).cast("long").alias("n_chars"), F.sha2(turn, 256).alias("turn_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    base, every = pii.digest(F.col("spans")), pii.digest(F.concat("spans", "term_spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = language.identify(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 0)
    return said.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort("hit_items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_katz": op4_katz,
    "op5_url_filter": op5_url_filter,
    "op6_transcripts": op6_transcripts,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
}
