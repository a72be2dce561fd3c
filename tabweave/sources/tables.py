"""Table, role and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """A parquet table or a headered CSV. Give CSVs a schema at scale: inference reads the file twice.

    ``multiline`` reads CSVs whose quoted texts hold line breaks; each file is then one task, however large.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def _json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON object of strings as ``(position, column, value)`` rows, in file order."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return text.select(F.posexplode(entries).alias("position", "entry")).select(
        "position", F.col("entry.key").alias("column"), F.col("entry.value").alias(value)
    )


def read_roles(spark: SparkSession, types: str, descriptions: str | None = None) -> DataFrame:
    """``(position, column, role, description, is_target)`` from a type map and a description map."""
    roles = _json_map(spark, types, "role")
    if descriptions is None:
        return roles.withColumns({"description": F.lit(None).cast("string"), "is_target": F.lit(False)})
    texts = _json_map(spark, descriptions, "description").drop("position")
    marked = F.coalesce(F.col("description").contains("Role: Target"), F.lit(False))
    return roles.join(texts, "column", "left").select(
        "position", "column", "role", "description", marked.alias("is_target")
    )


def target_column(roles: DataFrame) -> str:
    """The first column described as the target. Role tables hold one row per column, so they fit the driver."""
    found = roles.filter("is_target").orderBy("position").select("column").take(1)
    if not found:
        raise ValueError("no column is described as the target")
    return found[0]["column"]


def write_generated(df: DataFrame, path: str) -> None:
    """Generated rows as headered CSV, one folder per repetition."""
    df.write.mode("overwrite").partitionBy("repetition").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Append long-format scores as JSON lines."""
    scores.write.mode("append").json(path)
