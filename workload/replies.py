"""Replies are rendered from orders with deterministic damage, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import dictionary, profile, replies
from tabweave.operators.chats import rows_to_json
from workload.common import query, table
from workload.encoding import DICTIONARY_SQL

COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
ROLES = {"o_orderkey": "int", "o_orderstatus": "str", "o_orderpriority": "str", "o_totalprice": "float"}

# Kind of damage by order key:
# 0 none, 1 trailing commas, 2 quotes and spaces, 3 price out of range, 4 unknown status, 5 a column missing, 6 decimals in the int.
KINDS = 7


def _pieces(spark, sf):
    kind = F.col("o_orderkey") % KINDS
    orders = table(spark, sf, "orders")
    price = F.when(kind == 3, F.col("o_totalprice") * 1000).otherwise(F.col("o_totalprice"))
    status = F.when(kind == 4, F.lit("unknown")).otherwise(F.col("o_orderstatus"))
    cents = price.cast("decimal(20,2)").cast("string")
    number = F.when(kind == 6, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise(F.col("o_orderkey").cast("string"))
    return orders.select(
        F.col("o_orderkey").alias("chat_id"), kind.alias("kind"), number.alias("n"), status.alias("s"),
        F.col("o_orderpriority").alias("p"), cents.alias("c"),
    )


def csv_replies(spark, sf):
    kind, n, s, p, c = (F.col(x) for x in ("kind", "n", "s", "p", "c"))
    line = (
        F.when(kind == 1, F.concat(F.concat_ws(",", n, s, p, c), F.lit(",,")))
        .when(kind == 2, F.concat(n, F.lit(", '"), s, F.lit("' ,\""), p, F.lit('", '), c))
        .when(kind == 5, F.concat_ws(",", n, s, p))
        .otherwise(F.concat_ws(",", n, s, p, c))
    )
    text = F.concat(F.lit("Here are the rows\n"), line, F.lit("\nHope this helps, yours"))
    return _pieces(spark, sf).select("chat_id", text.alias("response"))


def json_replies(spark, sf):
    """Kinds as for CSV, but: 1 trailing comma, 2 single quotes and line breaks, 5 missing key; 6 leading zeros; 0 missing comma."""
    kind, n, s, p, c = (F.col(x) for x in ("kind", "n", "s", "p", "c"))
    q = lambda name, v: F.concat(F.lit(f'"{name}": "'), v, F.lit('"'))
    num = lambda name, v: F.concat(F.lit(f'"{name}": '), v)
    key = F.when(kind == 6, F.concat(F.lit("00"), F.col("chat_id").cast("string"))).otherwise(F.col("chat_id").cast("string"))
    members = [num("o_orderkey", key), q("o_orderstatus", s), q("o_orderpriority", p), num("o_totalprice", c)]
    whole = F.concat_ws(", ", *members)
    body = (
        F.when(kind == 0, F.concat_ws(" ", members[0], F.concat_ws(", ", *members[1:])))
        .when(kind == 1, F.concat(whole, F.lit(",")))
        .when(kind == 2, F.translate(F.concat_ws(",\n", *members), '"', "'"))
        .when(kind == 5, F.concat_ws(", ", *members[:3]))
        .otherwise(whole)
    )
    text = F.concat(F.lit("Sure:\n```json\n{"), body, F.lit("}\n``` and {this is no object}"))
    return _pieces(spark, sf).select("chat_id", text.alias("response"))


# What each kind of row looks like after parsing, before validation.
PIECES_SQL = f"""
pieces AS (SELECT o_orderkey AS chat_id, o_orderkey % {KINDS} AS kind,
  CASE WHEN o_orderkey % {KINDS} = 4 THEN 'unknown' ELSE o_orderstatus END AS s, o_orderpriority AS p,
  CAST(CAST(CASE WHEN o_orderkey % {KINDS} = 3 THEN o_totalprice * 1000 ELSE o_totalprice END AS DECIMAL(20,2)) AS VARCHAR) AS c FROM orders)"""


@query(
    f"""WITH {PIECES_SQL}
    SELECT chat_id, 1::INTEGER AS position, CAST(chat_id AS VARCHAR) || CASE WHEN kind = 6 THEN '.0' ELSE '' END AS o_orderkey,
      s AS o_orderstatus, p AS o_orderpriority, c AS o_totalprice FROM pieces WHERE kind <> 5"""
)
def parse_csv_replies(spark, sf):
    return replies.parse_csv_replies(csv_replies(spark, sf), COLS)


@query(
    f"""WITH {PIECES_SQL}
    SELECT chat_id, count(*) AS objects FROM (
      SELECT chat_id FROM pieces UNION ALL SELECT chat_id FROM pieces) GROUP BY chat_id"""
)
def extract_json_objects(spark, sf):
    found = replies.extract_json_objects(json_replies(spark, sf))
    return found.groupBy("chat_id").agg(F.count("*").alias("objects"))


@query(
    f"""WITH {PIECES_SQL}
    SELECT chat_id, '{{"o_orderkey": ' || chat_id || CASE WHEN kind = 0 THEN ',' ELSE ', ' END || '"o_orderstatus": "' || s || '", "o_orderpriority": "' || p || '"'
      || CASE WHEN kind = 5 THEN '' ELSE ', "o_totalprice": ' || c END || '}}' AS object
    FROM pieces WHERE kind <> 2
    UNION ALL
    SELECT chat_id, '{{"o_orderkey": ' || chat_id || ',"o_orderstatus": "' || s || '","o_orderpriority": "' || p || '","o_totalprice": ' || c || '}}'
    FROM pieces WHERE kind = 2
    UNION ALL SELECT chat_id, '{{this is no object}}' FROM pieces"""
)
def repair_json(spark, sf):
    found = replies.extract_json_objects(json_replies(spark, sf))
    return found.select("chat_id", replies.repair_json(F.col("object")).alias("object"))


_PARSED_JSON = f"""WITH {PIECES_SQL}
    SELECT chat_id, 0::INTEGER AS position, CAST(chat_id AS VARCHAR) AS o_orderkey, s AS o_orderstatus, p AS o_orderpriority,
      CAST(c AS DOUBLE) AS o_totalprice FROM pieces WHERE kind <> 5"""


@query(_PARSED_JSON)
def parse_json_replies(spark, sf):
    rows = replies.parse_json_replies(json_replies(spark, sf), COLS)
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(_PARSED_JSON)
def parse_json_replies_exact(spark, sf):
    rows = replies.parse_json_replies(json_replies(spark, sf), COLS, exact=True)
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(f"""WITH {PIECES_SQL} SELECT chat_id, 0::INTEGER AS position, s AS o_orderstatus FROM pieces""")
def parse_json_replies_superset(spark, sf):
    """Objects may have more keys than asked for."""
    return replies.parse_json_replies(json_replies(spark, sf), ["o_orderstatus"])


@query(
    f"""WITH {PIECES_SQL}
    SELECT chat_id, '{{"o_orderkey": ' || chat_id
      || CASE WHEN kind IN (0, 2) THEN ',' ELSE ', ' END || '"o_orderstatus": "' || s || '"'
      || CASE WHEN kind = 2 THEN ',' ELSE ', ' END || '"o_orderpriority": "' || p || '"'
      || CASE WHEN kind = 5 THEN '' WHEN kind = 2 THEN ',"o_totalprice": ' || c ELSE ', "o_totalprice": ' || c END || '}}' AS response
    FROM pieces"""
)
def normalise_reply(spark, sf):
    return replies.normalise_reply(json_replies(spark, sf))


_VALID = f"""WITH {DICTIONARY_SQL}, {PIECES_SQL},
  bounds AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  checked AS (SELECT chat_id, kind, chat_id AS o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority,
      CAST(c AS DOUBLE) AS o_totalprice,
      CASE WHEN CAST(c AS DOUBLE) < lo OR CAST(c AS DOUBLE) > hi THEN 'o_totalprice: out of range'
        WHEN s.code IS NULL THEN 'o_orderstatus: unknown category' END AS reason
    FROM pieces CROSS JOIN bounds
    LEFT JOIN dict s ON s."column" = 'o_orderstatus' AND s.value = pieces.s
    LEFT JOIN dict p ON p."column" = 'o_orderpriority' AND p.value = pieces.p
    WHERE kind <> 5)"""


def _checked(spark, sf, parsed):
    orders = table(spark, sf, "orders")
    bounds = profile.column_moments(orders, ["o_orderkey", "o_totalprice"])
    labels = dictionary.fit_dictionary(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return replies.validate_rows(parsed, bounds, labels, ROLES).drop("position")


@query(f"{_VALID} SELECT chat_id, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, reason FROM checked")
def validate_csv_rows(spark, sf):
    return _checked(spark, sf, replies.parse_csv_replies(csv_replies(spark, sf), COLS))


@query(f"{_VALID} SELECT chat_id, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM checked WHERE reason IS NULL")
def accept_json_rows(spark, sf):
    return replies.accepted(_checked(spark, sf, replies.parse_json_replies(json_replies(spark, sf), COLS)))


@query(f"{_VALID} SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def reject_reasons(spark, sf):
    bad = replies.rejected(_checked(spark, sf, replies.parse_json_replies(json_replies(spark, sf), COLS)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT c_nationkey, string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}', chr(10)
        ORDER BY c_custkey) AS response FROM customer GROUP BY c_nationkey"""
)
def rows_to_json_compact(spark, sf):
    rows = table(spark, sf, "customer")
    return rows_to_json(rows, ["c_custkey", "c_mktsegment"], ["c_nationkey"], ["c_custkey"], pretty=False)


@query(
    """SELECT o_orderkey, '{' || chr(10) || '    "o_orderkey":' || o_orderkey || ',' || chr(10) || '    "o_totalprice":'
        || CAST(o_totalprice AS VARCHAR) || ',' || chr(10) || '    "o_orderstatus":"' || o_orderstatus || '"' || chr(10) || '}' AS response
       FROM orders"""
)
def rows_to_json_pretty(spark, sf):
    return rows_to_json(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderkey"], ["o_orderkey"])
