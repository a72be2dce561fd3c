"""Shared inputs and SQL fragments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.numeric import rounded
from tabweave.session import checkpoint_folder
from tabweave.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query, with its SQL counterpart if there is one."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    return f"{checkpoint_folder(spark)}/tabweave/{name}-{uuid.uuid4().hex}"


def trimmed(df: DataFrame, places: int, *cols: str) -> DataFrame:
    """Round computed doubles so that the last bits do not count."""
    return df.withColumns({c: rounded(F.col(f"`{c}`"), places) for c in cols})


def r(expr: str, places: int = 6) -> str:
    """SQL for a rounded double without a negative zero."""
    return f"(CASE WHEN round({expr}, {places}) = 0 THEN 0::DOUBLE ELSE round({expr}, {places})::DOUBLE END)"


def hash_sql(seed: int, *keys: str) -> str:
    """SQL for the seeded hash."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 13) AS BIGINT)"


def unit_sql(seed: int, *keys: str) -> str:
    return f"({hash_sql(seed, *keys)}::DOUBLE / 4503599627370496::DOUBLE)"


def normal_sql(seed: int, *keys: str) -> str:
    u, v = unit_sql(seed, *keys, "'radius'"), unit_sql(seed, *keys, "'angle'")
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


LINEITEM_ROLES = {
    "l_returnflag": "str",
    "l_linestatus": "str",
    "l_quantity": "float",
    "l_extendedprice": "float",
    "l_discount": "float",
    "l_tax": "float",
}
LINEITEM_CATS = ["l_returnflag", "l_linestatus"]
LINEITEM_CONTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Orders with columns that are associated on purpose.
SALES_ROLES = {
    "status": "str", "priority": "str", "band": "str", "half": "str", "quarter": "str",
    "price": "float", "duty": "float", "month": "int",
}
SALES_CATS = ["status", "priority", "band", "half", "quarter"]
SALES_CONTS = ["price", "duty", "month"]
SALES_SQL = """
sales AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority,
    CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS band,
    CASE WHEN month(o_orderdate) <= 6 THEN 'first' ELSE 'second' END AS half,
    'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
    o_totalprice AS price,
    o_totalprice * 0.25 + month(o_orderdate) * 5000 AS duty,
    CAST(month(o_orderdate) AS BIGINT) AS month
  FROM orders
)"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    price, month = F.col("o_totalprice"), F.month("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(price < 100000, "low").when(price < 300000, "middle").otherwise("high").alias("band"),
        F.when(month <= 6, "first").otherwise("second").alias("half"),
        F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
        price.alias("price"),
        (price * 0.25 + month * 5000).alias("duty"),
        month.cast("bigint").alias("month"),
    )


def unpivot_sql(cols: list[str], source: str, kind: str, extra: str = "") -> str:
    """SQL for ``(column, value)`` rows of some columns; ``extra`` adds columns, with a trailing comma."""
    return " UNION ALL ".join(
        f"SELECT {extra} '{c}' AS \"column\", CAST({c} AS {kind}) AS value FROM {source}" for c in cols
    )


def long_array(messages: Column) -> Column:
    """Messages as one comparable text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
