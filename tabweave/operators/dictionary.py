"""Category dictionaries: fit, encode, decode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import ENTRY_BYTES, long_values, lookup
from tabweave.functions.numeric import rounded
from tabweave.functions.ordering import in_order_parts, running_total
from tabweave.roles import Roles, cat_cols


def fit_dictionary(
    df: DataFrame, cats: Sequence[str], order_key: str, rows_per_part: int | None = None
) -> DataFrame:
    """``(column, value, code, n, prob)``; the code is the 0-based rank by first appearance in ``order_key`` order.

    One shuffle groups all columns at once, after map-side counting. Codes come from partwise ranks over the distinct
    values, so a column with very many values is not ranked in one task.
    """
    long = df.select(F.col(order_key).alias("_order"), F.explode(long_values(cats)).alias("_v")).select("_order", "_v.*")
    values = long.groupBy("column", "value").agg(F.min("_order").alias("_first"), F.count("*").alias("n"))
    tagged, split = in_order_parts(values, ["column", "_first", "value"], df.count() * len(cats), rows_per_part)
    ranked = running_total(tagged, ["column"], ["_first", "value"], F.lit(1).cast("bigint"), "_rank", split=split)
    rows = df.agg(F.count("*").alias("rows")).scalar()
    return ranked.select(
        "column",
        "value",
        (F.col("_rank") - 1).alias("code"),
        "n",
        rounded(F.col("n") / rows, 3).alias("prob"),
    )


def dictionary_sizes(dictionary: DataFrame) -> dict[str, int]:
    """Size of each column's dictionary in entries of ordinary length: one small row per column reaches the driver."""
    text = F.ceil(F.sum(F.octet_length("value")) / ENTRY_BYTES)
    sizes = dictionary.groupBy("column").agg(F.greatest(F.count("*"), text).alias("size"))
    return {r["column"]: r["size"] for r in sizes.collect()}


def encode(df: DataFrame, dictionary: DataFrame, roles: Roles, sizes: dict[str, int] | None = None) -> DataFrame:
    """Replace category texts by codes and truncate int columns; rows with an unknown category are dropped."""
    sizes = dictionary_sizes(dictionary) if sizes is None else sizes
    out = df
    for c in cat_cols(roles):
        entries = dictionary.filter(F.col("column") == c)
        out = lookup(out, c, entries, "value", "code", c, sizes.get(c, 0), "n")
    ints = {c: F.col(f"`{c}`").cast("bigint") for c, r in roles.items() if r == "int"}
    out = out.na.drop("any")
    return out.withColumns(ints) if ints else out


def decode(df: DataFrame, dictionary: DataFrame, roles: Roles, sizes: dict[str, int] | None = None) -> DataFrame:
    """Replace codes by category texts; an unknown code becomes null."""
    sizes = dictionary_sizes(dictionary) if sizes is None else sizes
    out = df
    for c in cat_cols(roles):
        entries = dictionary.filter(F.col("column") == c).withColumn("code", F.col("code").cast("string"))
        out = lookup(out, c, entries, "code", "value", c, sizes.get(c, 0), "n")
    return out
