from __future__ import annotations



from tabweave.operators import dictionary
from workload.common import query, r, table

ROLES = {"o_orderstatus": "str", "o_orderpriority": "str", "o_totalprice": "int"}
CATS = ["o_orderstatus", "o_orderpriority"]

DICTIONARY_SQL = f"""
dict AS (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY first, value) - 1 AS code, n,
    {r('n / (SELECT count(*) FROM orders)', 3)} AS prob
  FROM (
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 2
    UNION ALL
    SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey), count(*) FROM orders GROUP BY 2
  ))"""


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *ROLES)


def fitted(spark, sf):
    return dictionary.fit_dictionary(orders(spark, sf), CATS, "o_orderkey")


@query(f"WITH {DICTIONARY_SQL} SELECT * FROM dict")
def fit_dictionary(spark, sf):
    return fitted(spark, sf)


@query(
    f"""WITH {DICTIONARY_SQL}
    SELECT o.o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority, CAST(trunc(o.o_totalprice) AS BIGINT) AS o_totalprice
    FROM orders o JOIN dict s ON s."column" = 'o_orderstatus' AND s.value = o.o_orderstatus
    JOIN dict p ON p."column" = 'o_orderpriority' AND p.value = o.o_orderpriority"""
)
def encode(spark, sf):
    return dictionary.encode(orders(spark, sf), fitted(spark, sf), ROLES)


@query(
    f"""WITH {DICTIONARY_SQL}
    SELECT o.o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority, CAST(trunc(o.o_totalprice) AS BIGINT) AS o_totalprice
    FROM orders o JOIN dict s ON s."column" = 'o_orderstatus' AND s.value = o.o_orderstatus
    JOIN dict p ON p."column" = 'o_orderpriority' AND p.value = o.o_orderpriority
    WHERE o.o_orderstatus <> 'P'"""
)
def encode_unknown_category(spark, sf):
    """A dictionary without one label: its rows have no code and drop out."""
    known = fitted(spark, sf).filter("not (column = 'o_orderstatus' and value = 'P')")
    return dictionary.encode(orders(spark, sf), known, ROLES)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders")
def decode(spark, sf):
    labels = fitted(spark, sf)
    return dictionary.decode(dictionary.encode(orders(spark, sf), labels, ROLES), labels, ROLES)
