"""The corpus pipeline: toxicity, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns as
Parquet into the shared checkpoint folder and reads it as the next one's docs. All but the last
stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carpalake.llm.common import Scratch, table
from carpalake.llm.decontamination import drop_leaking
from carpalake.llm.exact_dedup import drop_exact
from carpalake.llm.packing import pack
from carpalake.llm.queries import word_tokenizer
from carpalake.llm.simhash import drop_near
from carpalake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. Cases as in drop_toxic: null and empty texts, null ids and repeated rows are judged like others; without labels all stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays. Cases as in drop_exact: a null text equals an empty one, a null id is less than any, of rows with one text and id one stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word Jaccard similarities of at least 0.8, the document with the smallest doc_id stays.

    Cases as in drop_near: null and wordless texts are equal, null ids stay only where there is no other, rows that repeat id and text stay or go together.
    """
    return drop_near(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Cases as in drop_leaking: texts without words leak nothing, without items all stay, repeated rows are judged like others."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences. Cases as in pack: null texts are empty, null ids and repeated rows are documents like others."""
    return pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity, decontamination and packing have no SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, before = Scratch(spark, "pipeline"), ""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.clear(before)
        before = name
    return docs
