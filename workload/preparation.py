from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabweave.functions.ordering import hash_rank
from tabweave.functions.seeded import seeded_hash
from tabweave.operators import prepare
from tabweave.sources import read_corpus, read_roles, read_table, target_column, write_corpus, write_generated, write_scores
from workload.common import hash_sql, query, scratch, table, unit_sql

ORDERS_GAPS_SQL = """
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
    nullif(o_orderpriority, '5-LOW') AS o_orderpriority
  FROM orders"""


def orders_with_gaps(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_totalprice",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )


@query("SELECT * FROM part", name="read_parquet_table")
def read_parquet_table(spark, sf):
    return read_table(spark, f"{sf}/part.parquet")


@query("SELECT * FROM part", name="read_csv_table")
def read_csv_table(spark, sf):
    part = table(spark, sf, "part")
    folder = scratch(spark, "part-csv")
    part.write.option("header", True).option("escape", '"').csv(folder)
    return read_table(spark, folder, "csv", part.schema)


@query(
    """SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // (count(*) OVER () // 3) AS repetition,
         o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY repetition < 3"""
)
def write_generated_repetitions(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = scratch(spark, "generated")
    write_generated(prepare.repetition_slices(orders, orders.count() // 3, 3, ["o_orderkey"]), folder)
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, repetition bigint"
    return read_table(spark, folder, "csv", schema)


@query(
    """SELECT 'orders' AS model, o_orderpriority AS metric, 'Count' AS grp, count(*)::DOUBLE AS score
       FROM orders GROUP BY o_orderpriority"""
)
def write_score_lines(spark, sf):
    scores = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(
        F.count("*").cast("double").alias("score")
    )
    folder = scratch(spark, "scores")
    write_scores(scores.withColumns({"model": F.lit("orders"), "grp": F.lit("Count")}), folder)
    return spark.read.schema("model string, metric string, grp string, score double").json(folder)


@query(
    """SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, turn, role, text AS content
       FROM conversations"""
)
def corpus_round_trip(spark, sf):
    from tabweave.operators.chats import collect_chats, long_messages
    from tabweave.plans.corpus import split_of

    chats = collect_chats(table(spark, sf, "conversations"))
    folder = scratch(spark, "corpus")
    write_corpus(chats.withColumn("split", split_of(F.col("conv_id"))), folder)
    parts = [
        long_messages(read_corpus(spark, folder, s), "conv_id").withColumn("split", F.lit(s)) for s in ("train", "eval")
    ]
    return parts[0].unionByName(parts[1])


@query("SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_columns(spark, sf):
    return prepare.drop_columns(table(spark, sf, "orders"), ["o_orderkey", "o_orderdate"])


@query(
    """SELECT p_partkey, p_brand, split_part(p_brand, '#', 1) AS brand_prefix, split_part(p_brand, '#', 2) AS brand_number
       FROM part"""
)
def split_code(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return prepare.split_code(part, "p_brand", "#", ["brand_prefix", "brand_number"])


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS o_orderstatus
       FROM orders"""
)
def recode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prepare.recode(orders, "o_orderstatus", {"O": "open", "F": "filled"})


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def move_last(spark, sf):
    return prepare.move_last(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT c_custkey, c_acctbal, c_mktsegment AS target FROM customer")
def rename_target(spark, sf):
    return prepare.rename_target(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment")


@query(f"SELECT * FROM ({ORDERS_GAPS_SQL}) WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL")
def drop_incomplete(spark, sf):
    return prepare.drop_incomplete(orders_with_gaps(spark, sf))


@query(
    f"""WITH g AS ({ORDERS_GAPS_SQL})
    SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS nulls FROM g
    UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus) FROM g
    UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM g
    UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g"""
)
def null_counts(spark, sf):
    return prepare.null_counts(orders_with_gaps(spark, sf))


@query("SELECT event_id, user_id, event_type, value FROM events")
def shuffle_rows(spark, sf):
    return prepare.shuffle(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"])


@query(
    f"""SELECT event_id, row_number() OVER (ORDER BY {hash_sql(42, 'event_id')}, event_id) AS position,
          count(*) OVER () AS rows FROM events"""
)
def shuffle_positions(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return hash_rank(events, [], seeded_hash(42, "event_id"), ["event_id"], "position", "rows")


_SPLIT = """WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN rn <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split
FROM k WHERE rn <= floor(n * 0.75) + floor(n * 0.25)"""


@query(_SPLIT.format(order="o_orderkey"))
def train_test_split_by_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prepare.train_test_split(orders, 10**12, 10**12, order=["o_orderkey"])


@query(_SPLIT.format(order=f"{hash_sql(42, 'o_orderkey')}, o_orderkey"))
def train_test_split_shuffled(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prepare.train_test_split(orders, 10**12, 10**12, key=["o_orderkey"])


@query(_SPLIT.format(order=f"{hash_sql(42, 'o_orderkey')}, o_orderkey"))
def train_test_split_by_boundaries(spark, sf):
    """The path of large tables: the rows at the boundaries are looked up and no row is moved."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prepare.train_test_split(orders, 10**12, 10**12, key=["o_orderkey"], rows_per_part=max(1, orders.count() // 4))


@query(
    """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // (count(*) OVER () // 3) AS repetition
       FROM events QUALIFY repetition < 3"""
)
def repetition_slices(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return prepare.repetition_slices(events, events.count() // 3, 3, ["event_id"])


@query(
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price_int, CAST(o_totalprice AS DOUBLE) AS price_float,
         CAST(NULL AS BIGINT) AS priority_int, o_orderstatus AS status_str, -CAST(trunc(o_totalprice) AS BIGINT) AS negative_int
       FROM orders"""
)
def cast_roles(spark, sf):
    price = F.col("o_totalprice")
    texts = table(spark, sf, "orders").select(
        "o_orderkey",
        price.cast("string").alias("price_int"),
        price.cast("string").alias("price_float"),
        F.col("o_orderpriority").alias("priority_int"),
        F.col("o_orderstatus").alias("status_str"),
        (-price).alias("negative_int"),
    )
    roles = {"price_int": "int", "price_float": "float", "priority_int": "int", "status_str": "str", "negative_int": "int"}
    return prepare.cast_roles(texts, roles)


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    f"""WITH k AS (SELECT DISTINCT conv_id FROM conversations),
    c AS (SELECT unnest({_COLUMNS}) AS col),
    ranked AS (
      SELECT conv_id, col,
        row_number() OVER (PARTITION BY conv_id ORDER BY {hash_sql(42, 'conv_id', 'col')}, col) AS rn,
        floor({unit_sql(42, 'conv_id', "'columns'")} * 4) AS n_drop
      FROM k, c WHERE col <> 'l_returnflag')
    SELECT conv_id, col AS "column" FROM ranked WHERE rn > n_drop
    UNION ALL SELECT conv_id, 'l_returnflag' FROM k"""
)
def drop_random_columns(spark, sf):
    keys = table(spark, sf, "conversations").select("conv_id").distinct()
    return prepare.drop_random_columns(keys, "conv_id", _COLUMNS, "l_returnflag")


_PART_ROLES = {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_size": "int", "p_retailprice": "float"}


def _described(c: str) -> str:
    return "Role: Target" if c == "p_brand" else "Role: Feature"


@query(
    "WITH d AS (" + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{r}' AS role, '{_described(c)}, values: ' || count(DISTINCT {c}) AS description FROM part"
        for i, (c, r) in enumerate(_PART_ROLES.items())
    ) + ") SELECT *, description LIKE '%Role: Target%' AS is_target, 'p_brand' AS target FROM d"
)
def read_role_map(spark, sf):
    """The role map of a table, written from its schema and read back, with the target it names."""
    from tabweave.roles import infer_roles

    part = table(spark, sf, "part").select(*_PART_ROLES)
    counts = part.agg(*[F.count_distinct(c).alias(c) for c in _PART_ROLES]).first()
    texts = {c: f"{_described(c)}, values: {counts[c]}" for c in _PART_ROLES}
    folders = []
    for name, content in (("types", infer_roles(part)), ("descriptions", texts)):
        folders.append(scratch(spark, name))
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(folders[-1])
    roles = read_roles(spark, *folders)
    return roles.withColumn("target", F.lit(target_column(roles)))
