"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``.

Inputs and edge cases: null and empty texts have too few words for the quality rules and go there; a null id is
carried along, decided by its text and packed as null; texts of any length are read whole; repeated rows are
copies, of which one stays; without labels only the base quality rules reject and nothing is toxic; an
empty table gives an empty result; further columns of any name are carried through to the packing stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import dedup, packing, quality, toxicity
from flowloom.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below 0.5."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: five-word shingles, similarity 0.8."""
    return dedup.keep_one(docs, shingle=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens, 2048 documents and a cost of 2048 squared."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Binomial bounds, gradient descent and merging tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
