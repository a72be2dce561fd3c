"""Clean training sequences from raw documents: four stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm.common import saved
from tabweave.llm.near_documents import drop_near_documents
from tabweave.llm.packing import pack_documents
from tabweave.llm.quality import drop_poor
from tabweave.llm.toxicity import drop_toxic
from tabweave.sources import read_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned on the labels does not call toxic."""
    return drop_toxic(docs, read_table(spark, f"{sf_dir}/labels.parquet"))


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer calls good."""
    return drop_poor(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents in training sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("quality", without_poor), ("near-duplicates", without_copies), ("packing", packed)]

# Learned models, signatures and packing have no counterpart in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; each stage's result is written and read again."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, f"stage-{name}")
    return docs
