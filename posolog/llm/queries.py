"""Registered queries of the operators in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm import collocations, exact_dedup, max_sketch, mixing
from posolog.llm.cap_filters import near_vectors
from posolog.llm.common import table
from posolog.llm.html_text import main_texts
from posolog.llm.line_dedup import without_recurring_lines
from posolog.llm.packing import packed
from posolog.llm.quality import quality_scores
from posolog.llm.repeated_bytes import without_repeats
from posolog.llm.simhash import simhash_components
from posolog.llm.token_counts import token_counts
from posolog.llm.toxicity import toxicity_scores


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and kept_sha256 of what is left (null text: empty)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return without_recurring_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_source_mix,
        op3_toxicity,
        op4_repeated_bytes,
        op5_packing,
        op6_line_templates,
        op7_simhash,
        op8_exact_dedup,
        op9_near_vectors,
        op10_main_text,
        op11_lexical_search,
        op12_collocations,
        op13_quality,
        pipeline,
    )
}

CHECKS: dict[str, str] = {
    "op2_source_mix": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_lexical_search": max_sketch.SQL,
    "op12_collocations": collocations.SQL,
}
