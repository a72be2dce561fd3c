from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from tabweave.operators import association, cards, chats, profile
from tabweave.plans.corpus import prefixes
from workload.associations import EDGES_SQL, sales_edges
from workload.cards import NUMERIC_CARD_SQL
from workload.common import LINEITEM_CONTS, SALES_CATS, SALES_ROLES, SALES_SQL, hash_sql, long_array, query, sales, table


def conversation_arrays(spark, sf):
    """``(chat_id, messages)`` of the conversations table."""
    whole = chats.collect_chats(table(spark, sf, "conversations"))
    return whole.select(F.col("conv_id").alias("chat_id"), "messages")


CHATS_SQL = """
ordered AS (SELECT conv_id AS chat_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


@query(
    f"""WITH {CHATS_SQL} SELECT chat_id, string_agg(role || ': ' || text, chr(10) ORDER BY i) AS text FROM ordered
    WHERE n <> 5 OR i IN (1, 4, 5) GROUP BY chat_id"""
)
def trim_history(spark, sf):
    trimmed = conversation_arrays(spark, sf).withColumn("messages", chats.trim_history(F.col("messages")))
    return trimmed.select("chat_id", long_array(F.col("messages")).alias("text"))


@query(
    f"""WITH {CHATS_SQL} SELECT chat_id, string_agg(role || ': ' || text, chr(10) ORDER BY i) AS text FROM ordered
    WHERE n <> 4 OR i > 2 GROUP BY chat_id"""
)
def trim_history_without_system(spark, sf):
    trimmed = conversation_arrays(spark, sf).withColumn("messages", chats.trim_history(F.col("messages"), system=False))
    return trimmed.select("chat_id", long_array(F.col("messages")).alias("text"))


@query(
    """SELECT conv_id, 0::BIGINT AS part, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS text
       FROM conversations GROUP BY ALL"""
)
def chat_to_text(spark, sf):
    return chats.chat_to_text(table(spark, sf, "conversations"))


@query(
    """SELECT conv_id, turn // 2 AS part, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS text
       FROM conversations GROUP BY ALL"""
)
def chat_to_text_long_chats(spark, sf):
    """Chats beyond the turn limit continue in further parts; nothing is cut off."""
    return chats.chat_to_text(table(spark, sf, "conversations"), turns_per_text=2)


@query(
    f"""WITH {CHATS_SQL} SELECT chat_id, i - 1 AS turn, role, text AS content FROM ordered"""
)
def long_messages(spark, sf):
    return chats.long_messages(conversation_arrays(spark, sf))


# One round: the first turn plays the reply, and assistant turns count as valid rows.
@query(
    f"""WITH {CHATS_SQL},
    counted AS (SELECT chat_id, count(*) FILTER (role = 'assistant') AS good FROM ordered GROUP BY 1),
    first AS (SELECT chat_id, text AS response FROM ordered WHERE i = 1),
    parts AS (
      SELECT chat_id, i, role || ': ' || text AS t FROM ordered JOIN counted USING (chat_id) WHERE good >= 3 OR i < n
      UNION ALL SELECT chat_id, 1000000, 'assistant: kept ' || response FROM first JOIN counted USING (chat_id) WHERE good >= 3)
    SELECT chat_id, CASE WHEN good >= 3 THEN 'accepted' ELSE 'retry' END AS status, coalesce(string_agg(t, chr(10) ORDER BY i), '') AS text,
      CASE WHEN good < 3 THEN any_value(response) END AS failed_with
    FROM counted LEFT JOIN parts USING (chat_id) LEFT JOIN first USING (chat_id) GROUP BY chat_id, good"""
)
def route_chats(spark, sf):
    arrays = conversation_arrays(spark, sf)
    replies = arrays.select("chat_id", F.col("messages")[0]["content"].alias("response"))
    valid = table(spark, sf, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("chat_id"), "turn")
    normalised = replies.select("chat_id", F.concat(F.lit("kept "), "response").alias("response"))
    routed = chats.route_chats(arrays, replies, valid, normalised, min_rows=3)
    last = F.element_at("failed", -1)["content"]
    return routed.select("chat_id", "status", long_array(F.col("messages")).alias("text"), last.alias("failed_with"))


@query(
    """WITH pairs AS (SELECT a.conv_id, a.turn AS group_no, a.text AS request, b.text AS response
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    lagged AS (SELECT p.*, q.request AS r0, q.response AS s0 FROM pairs p LEFT JOIN pairs q ON q.conv_id = p.conv_id AND q.group_no = p.group_no - 1)
    SELECT conv_id, group_no, CASE WHEN conv_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
      CASE WHEN r0 IS NULL THEN 3 ELSE 5 END::INTEGER AS messages,
      CASE WHEN r0 IS NULL THEN '' ELSE 'user: ' || r0 || chr(10) || 'assistant: ' || s0 || chr(10) END
        || 'user: ' || request || chr(10) || 'assistant: ' || response AS text
    FROM lagged"""
)
def corpus_prefixes(spark, sf):
    """Every turn with the turn after it plays a request and its response."""
    turns = table(spark, sf, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("group_no"), F.col("text").alias("response"))
    pairs = turns.select("conv_id", F.col("turn").alias("group_no"), F.col("text").alias("request")).join(
        answers, ["conv_id", "group_no"]
    )
    made = prefixes(pairs.select("conv_id", "group_no", "request", "response"))
    body = F.slice("messages", 2, 10)
    return made.select("conv_id", "group_no", "split", F.size("messages").alias("messages"), long_array(body).alias("text"))


# One key: the eight sales columns in their natural order. First fit by hand in SQL would need recursion over columns;
# the sets that may not share a group are what the edges say.
@query(
    f"""WITH RECURSIVE {SALES_SQL}, {EDGES_SQL},
    cols AS (SELECT unnest({list(SALES_ROLES)}) AS c, unnest(range(1, {len(SALES_ROLES) + 1})) AS i),
    near AS (SELECT i, c, coalesce(list(other) FILTER (other IS NOT NULL), []) AS near FROM cols LEFT JOIN edges ON edges."column" = c GROUP BY i, c),
    fold AS (
      SELECT 0::BIGINT AS i, []::VARCHAR[][] AS groups
      UNION ALL
      SELECT near.i, CASE WHEN fits = 0 THEN list_append(groups, [near.c])
          ELSE list_transform(groups, lambda g, k: CASE WHEN k = fits THEN list_append(g, near.c) ELSE g END) END
      FROM (SELECT f.i, f.groups, coalesce(list_position(list_transform(f.groups, lambda g: len(g) < 8 AND NOT list_has_any(g, m.near)), TRUE), 0) AS fits
            FROM fold f JOIN near m ON m.i = f.i + 1) step JOIN near ON near.i = step.i + 1)
    SELECT CAST(k - 1 AS INTEGER) AS group_no, array_to_string(groups[k], ',') AS columns
    FROM (SELECT groups, unnest(range(1, len(groups) + 1)) AS k FROM fold WHERE i = {len(SALES_ROLES)})"""
)
def column_groups(spark, sf):
    place = F.create_map(*[F.lit(x) for i, c in enumerate(SALES_ROLES) for x in (c, i)])
    names = F.explode(F.array(*[F.lit(c) for c in SALES_ROLES])).alias("column")
    columns = sales(spark, sf).agg(F.count("*")).select(names).withColumn("position", F.element_at(place, F.col("column")))
    groups = chats.column_groups(columns, sales_edges(spark, sf))
    return groups.select("group_no", F.array_join("columns", ",").alias("columns"))


_EVENT_COLUMNS = ["value", "hour", "cost"]


@query(
    f"""WITH RECURSIVE d AS (SELECT event_type, value, hour(ts) AS hour, value * 2 + hour(ts) AS cost FROM events),
    matrix AS ({" UNION ALL ".join(f"SELECT event_type, '{a}' AS c, '{b}' AS other, corr({a}, {b}) AS v FROM d GROUP BY 1" for a in _EVENT_COLUMNS for b in _EVENT_COLUMNS if a != b)}),
    cols AS (SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql(42, "event_type", "c")}, c) AS i
      FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest({_EVENT_COLUMNS}) AS c)),
    near AS (SELECT event_type, i, c, coalesce(list(other) FILTER (other IS NOT NULL), []) AS near
      FROM cols LEFT JOIN (SELECT * FROM matrix WHERE abs(v) > 0.2) USING (event_type, c) GROUP BY event_type, i, c),
    fold AS (
      SELECT DISTINCT event_type, 0::BIGINT AS i, []::VARCHAR[][] AS groups FROM events
      UNION ALL
      SELECT step.event_type, near.i, CASE WHEN fits = 0 THEN list_append(groups, [near.c])
          ELSE list_transform(groups, lambda g, k: CASE WHEN k = fits THEN list_append(g, near.c) ELSE g END) END
      FROM (SELECT f.event_type, f.i, f.groups, coalesce(list_position(list_transform(f.groups, lambda g: len(g) < 8 AND NOT list_has_any(g, m.near)), TRUE), 0) AS fits
            FROM fold f JOIN near m ON m.event_type = f.event_type AND m.i = f.i + 1) step JOIN near ON near.event_type = step.event_type AND near.i = step.i + 1)
    SELECT event_type, CAST(k - 1 AS INTEGER) AS group_no, array_to_string(groups[k], ',') AS columns
    FROM (SELECT event_type, groups, unnest(range(1, len(groups) + 1)) AS k FROM fold WHERE i = {len(_EVENT_COLUMNS)})"""
)
def column_groups_per_key(spark, sf):
    """Own edges and a random column order for every event type."""
    from tabweave.functions.seeded import seeded_hash

    events = table(spark, sf, "events").select(
        "event_type", "value", F.hour("ts").alias("hour"), (F.col("value") * 2 + F.hour("ts")).alias("cost")
    )
    roles = {"value": "float", "hour": "int", "cost": "float"}
    edges = association.association_edges(events, roles, keys=["event_type"])
    names = F.explode(F.array(*[F.lit(c) for c in roles])).alias("column")
    columns = events.select("event_type").distinct().select("event_type", names)
    placed = columns.withColumn("place", seeded_hash(42, "event_type", "column"))
    return chats.column_groups(placed, edges, ["event_type"], order="place").withColumn("columns", F.array_join("columns", ","))


def _sheet(spark, sf):
    body = cards.numeric_card(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS))
    return cards.column_card(body, {c: "float" for c in LINEITEM_CONTS})


def _chat_sql(form: str, rows: int) -> str:
    body = NUMERIC_CARD_SQL.replace(
        'SELECT "column", ', """SELECT list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], "column") AS position,
          '# Column: ' || "column" || chr(10) || 'Type: float' || chr(10) || """, 1
    ).replace("AS body", "AS card")
    text = f"\n\nWrite {rows} new rows. {chats.RULES} Use {form}".replace("'", "''")
    return f"""SELECT c_custkey AS chat_id, 'system: {chats.SYSTEM}' || chr(10) || 'user: ' || sheet || '{text}' AS text
      FROM customer CROSS JOIN (SELECT string_agg(card, chr(10) || chr(10) ORDER BY position) AS sheet FROM ({body}))"""


@query(_chat_sql("one line per row, comma separated, in this column order:\n" + ",".join(LINEITEM_CONTS), chats.CSV_ROWS_ASKED))
def build_chats_csv(spark, sf):
    """As many chats as there are customers."""
    n = table(spark, sf, "customer").count()
    made = chats.build_chats(_sheet(spark, sf), LINEITEM_CONTS, n, "csv")
    return made.select("chat_id", long_array(F.col("messages")).alias("text"))


@query(_chat_sql("one JSON object per row, like this with real values:\n" + chats.example_object(LINEITEM_CONTS), chats.ROWS_ASKED))
def build_chats_json(spark, sf):
    n = table(spark, sf, "customer").count()
    made = chats.build_chats(_sheet(spark, sf), LINEITEM_CONTS, n, "json")
    return made.select("chat_id", long_array(F.col("messages")).alias("text"))


@query(
    f"""WITH {CHATS_SQL} SELECT chat_id, 'reply to ' || max(n) || ' turns, last by ' || max(role) FILTER (i = n) AS response,
      CAST(NULL AS VARCHAR) AS error FROM ordered GROUP BY chat_id"""
)
def complete_chats(spark, sf):
    def answer(talks):
        return [f"reply to {len(t)} turns, last by {t[-1]['role']}" for t in talks]

    return chats.complete_chats(conversation_arrays(spark, sf), answer)


@query(f"WITH {CHATS_SQL} SELECT DISTINCT chat_id, CAST(NULL AS VARCHAR) AS response, 'RuntimeError: model is down' AS error FROM ordered")
def complete_chats_failing(spark, sf):
    """A model that always fails leaves its error in every row."""

    def answer(talks):
        raise RuntimeError("model is down")

    return chats.complete_chats(conversation_arrays(spark, sf), answer)


# Rows that the stand-in for a model completes before its reply breaks off.
MODEL_SEED, MODEL_ROWS = 42, 15


def card_model(seed: int, rows: int):
    """A stand-in for a model. It reads ranges and labels from the cards it has been shown, copies the rows of its last
    reply and puts seeded values of the new columns behind them. Its reply has text around the rows and breaks off in
    the middle of the next one."""

    def answer(talks):
        out = []
        for talk in talks:
            request = talk[-1]["content"]
            known = re.findall(r'"([^"]+)": "<value>"', request)
            cards = {c: body for c, body in re.findall(r"# Column: (.+)\n((?:(?!# Column: ).*\n?)+)", request)}
            earlier = [json.loads(x) for x in re.findall(r"\{[^{}]*\}", talk[-2]["content"])] if talk[-2:-1] and talk[-2]["role"] == "assistant" else [{}] * (rows + 1)
            made = []
            for j, row in enumerate(earlier):
                row = dict(row)
                for c in [c for c in known if c in cards]:
                    digest = hashlib.md5(f"{seed}|{c}|{j}".encode()).hexdigest()
                    draw = lambda n: int(digest[:13], 16) * n >> 52
                    limits = re.search(r"minimum (-?[0-9.]+), maximum (-?[0-9.]+[0-9])", cards[c])
                    if not limits:
                        labels = re.findall(r"^- (.*): in (?:fewer than )?\d+ of 100 rows$", cards[c], re.M)
                        row[c] = labels[draw(len(labels))]
                        continue
                    low, high = (round(float(x) * 1000) for x in limits.groups())
                    if "Type: int" in cards[c]:
                        row[c] = low // 1000 + draw(high // 1000 - low // 1000 + 1)
                    else:
                        # Inside the limits, which a card shows to three decimals.
                        row[c] = (low + 1 + draw(high - low - 1)) / 1000
                made.append(json.dumps(row))
            cut = made[rows:] or [made[-1]]
            out.append("Here are the rows:\n" + "\n".join(made[:rows]) + "\n" + cut[0][: len(cut[0]) // 2])
        return out

    return answer


def generated_sql(chats_of_batch: str, asked: str = "SELECT count(*) AS need FROM customer", roles=tuple(SALES_ROLES), source: str = SALES_SQL) -> str:
    """Rows by the model's rule, ``asked`` in all; ``chats_of_batch`` gives the number of chats that answer, by ``need``."""
    draw = lambda c, n: f"({hash_sql(MODEL_SEED, repr(c), 'j')}::HUGEINT * {n} // 4503599627370496)::BIGINT"
    limit = lambda f, c: f"(SELECT round(round({f}({c}), 3) * 1000) FROM sales)::BIGINT"
    rule = {c: draw(c, f"(SELECT count(DISTINCT {c}) FROM sales)") for c in SALES_CATS}
    rule |= {c: f"({limit('min', c)} + 1 + {draw(c, f'({limit("max", c)} - {limit("min", c)} - 1)')})::DOUBLE / 1000" for c in ("price", "duty")}
    rule["month"] = "(SELECT min(month) FROM sales) + " + draw("month", "(SELECT max(month) - min(month) + 1 FROM sales)")
    return f"""WITH {source}, asked AS ({asked}),
    batches AS (SELECT 0 AS batch, {chats_of_batch} AS n FROM asked),
    more AS (SELECT * FROM batches UNION ALL SELECT 1, ceil((need - n * {MODEL_ROWS}) / {MODEL_ROWS})::BIGINT FROM batches, asked WHERE need > n * {MODEL_ROWS}),
    rows AS (SELECT j, {", ".join(f"{rule[c]} AS {c}" for c in roles)} FROM (SELECT unnest(range({MODEL_ROWS})) AS j))
    SELECT batch, chat_id, j::INTEGER AS position, {", ".join(roles)}
    FROM (SELECT batch, unnest(range(n)) AS chat_id FROM more) CROSS JOIN rows ORDER BY batch, chat_id, j LIMIT (SELECT need FROM asked)"""


def _generate(spark, sf, variant, **options):
    from tabweave.plans.generating import generate_rows
    from tabweave.plans.profiling import profile_table

    p = profile_table(sales(spark, sf), SALES_ROLES, "id", shapes=variant == "columnwise_relationships_json")
    model = card_model(MODEL_SEED, MODEL_ROWS)
    return generate_rows(p, model, table(spark, sf, "customer").count(), variant, **options)


@query(generated_sql("ceil(need / 16)::BIGINT"))
def generate_rows_json(spark, sf):
    """As many rows as there are customers; the first batch is short of them."""
    return _generate(spark, sf, "json_relationships")


# Chats are started for groups that may fail, so the first batch has enough rows.
@query(generated_sql("need"))
def generate_rows_columnwise(spark, sf):
    return _generate(spark, sf, "columnwise_relationships_json")


@query(generated_sql("need"))
def generate_rows_without_system(spark, sf):
    """Column-wise chats for models that take no system message."""
    return _generate(spark, sf, "columnwise_relationships_json_nodist", system=False)


@query()
def build_corpus(spark, sf):
    from tabweave.plans.corpus import build_corpus as build

    made = build(sales(spark, sf), SALES_ROLES, "band", ["id"], num_examples=50)
    return made.withColumn("messages", long_array(F.col("messages")))
