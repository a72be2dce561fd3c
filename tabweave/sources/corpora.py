"""Chat corpora on disk, one folder per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Write ``corpus`` with its ``split`` column (``train`` or ``eval``) as the folder key."""
    corpus.write.mode("overwrite").partitionBy("split").parquet(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a corpus; a split is pruned to its folder."""
    corpus = spark.read.parquet(path)
    return corpus.filter(F.col("split") == split) if split else corpus
