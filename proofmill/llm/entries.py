"""Queries over the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import chat, decontaminate, exactdedup, idstore, jaccard, mixing, quality, secrets, toxicity, wordpiece
from proofmill.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``; see ``secrets.scan_secrets`` for null, empty and repeated rows."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, classes and numbers of links of all ``documents``; see ``jaccard.jaccard_classes`` for the edge cases."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` in reply order without quotations; see ``chat.format_chat`` for the edge cases."""
    return chat.chat_rows(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of ``benchmark`` by their templates; see ``decontaminate.contamination`` for the edge cases."""
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), template_only=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learnt from ``labels``; see ``toxicity.score_toxicity`` for the edge cases."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every text of ``documents``; see ``wordpiece.count_pieces`` for the edge cases."""
    return wordpiece.count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents``, written to the store and read back; see ``idstore.token_store`` for the edge cases."""
    return idstore.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learnt from ``labels``; see ``quality.score_quality`` for the edge cases."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of sources takes of each of ``documents``; see ``mixing.mix_sources`` for the edge cases."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``; see ``exactdedup.exact_dedup`` for the edge cases."""
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_token_output": op7_token_output,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op4_decontamination": decontaminate.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op10_exact_dedup": exactdedup.ORACLE,
    }
