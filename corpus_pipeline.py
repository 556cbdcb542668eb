"""From raw documents to packed training sequences: STAGES, each from a DataFrame of documents to the next one's.

All stages but the last return the columns of documents, whatever their names. Null texts count as empty, null doc_ids keep
their rows, empty tables give empty results; what becomes of repeated rows and ties is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import documents, materialise
from quillspark.llm.packing import pack
from quillspark.llm.quality_rules import keep_good
from quillspark.llm.secrets import redact_secrets
from quillspark.llm.simhash import drop_near_duplicates
from quillspark.llm.substring_dedup import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, empty ones among them; repeated rows are judged each for itself."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles reach a similarity of 0.8 to one that stays, none stays; of rows with equal sets of
    shingles, the one with the smallest doc_id (of rows that are equal in both, one)."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that stand anywhere else go, at each place, and n_chars follows; every document stays."""
    return drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [SECRET], and n_chars follows; every document stays."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence; an empty document is its end token alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The trees of a forest and a branch-and-bound search are beyond SQL; tests/llm/test_pipeline.py holds each stage against a
#: plain version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
