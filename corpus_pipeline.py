"""The corpus pipeline: five operators in turn, each stage written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents, whatever these are; columns whose names an operator uses itself do no harm. Rows with
null ids, null, empty and repeated texts go through every stage as its operator's docstring says, and an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import decontaminate, idstore, jaccard, mixing, toxicity
from proofmill.llm.common import table
from proofmill.session import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; null and empty texts get its base rate and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity connect, the one with the smallest id stays; texts without words all stay."""
    return jaccard.drop_near_duplicates(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, texts without words count nothing."""
    return mixing.emit_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to the content-addressed store and read back; repeated rows are all there, null ids last."""
    return idstore.token_store(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: The classifier and the tokenizer are not SQL; tests hold each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a table in the shared folder before the next reads it.

    One row for each emitted copy: doc_id, start, n_tokens, ids_crc32.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
