"""From raw documents to token shards, in five stages.

Each stage works on all that its predecessor kept. Its result is written as
Parquet before the next one starts, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import common
from lodeworks.llm.decontaminate import decontaminate
from lodeworks.llm.mixing import mixed_documents
from lodeworks.llm.near_dedup import drop_near_duplicates
from lodeworks.llm.quality import keep_quality
from lodeworks.llm.token_store import token_output, vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Edge cases: ``quality_scores``, ``keep_quality``."""
    return keep_quality(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id. Edge cases: ``near_dedup``, ``drop_near_duplicates``."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Edge cases: ``decontamination_report``, ``decontaminate``."""
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"), mode="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order. Edge cases: ``mix``, ``mixed_documents``."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and a row for each document read back from them. Edge cases: ``write_tokens``, ``read_tokens``."""
    return token_output(docs, vocabulary_path(spark), special=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Trained scores and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        known = common.written()
        result = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return result
        docs = common.materialize(result, f"stage-{name}")
        made = [x for x in common.written() if x not in known]
        common.release(spark, before + made[:-1])  # what the stage before returned, and what this one worked with
        before = made[-1:]
    return docs
