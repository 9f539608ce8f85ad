"""Registered queries of the corpus operators: name to (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import (
    exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, resampling, sentence_pieces, sharding, spelling,
    token_matrix, url_filter,
)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("capacity")


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("print")


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumn("broken", F.array_join("broken", ","))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("print")


def op7_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("print")


def op9_token_matrix(spark, sf_dir):
    return token_matrix.token_matrix(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE)


def op12_sentence_pieces(spark, sf_dir):
    return sentence_pieces.digest(table(spark, sf_dir, "documents"))


def op13_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    "op1_sharding": (op1_sharding, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_near_dedup": (op4_near_dedup, None),
    "op5_quality_rules": (op5_quality_rules, quality_rules.SQL),
    "op6_exact_dedup": (op6_exact_dedup, exact_dedup.SQL),
    "op7_pii": (op7_pii, pii.SQL),
    "op8_mixing": (op8_mixing, mixing.SQL),
    "op9_token_matrix": (op9_token_matrix, None),
    "op10_url_filter": (op10_url_filter, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_sentence_pieces": (op12_sentence_pieces, None),
    "op13_resampling": (op13_resampling, None),
}
