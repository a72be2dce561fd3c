"""Chats as rows: ``(chat_id, messages)`` with ``messages`` an array of ``(role, content)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.lookup import one_row
from tabweave.functions.numeric import plain_number
from tabweave.sources.corpora import MESSAGES

# Group size limit, valid rows a reply needs, share of chats expected to survive a group.
MAX_GROUP = 8
MIN_ROWS = 8
SURVIVING = 0.96
# Rows a chat asks for.
ROWS_ASKED, CSV_ROWS_ASKED = 20, 25

SYSTEM = (
    "You write synthetic rows for a table. Column descriptions tell you the types, frequencies, ranges and "
    "relationships the rows have to respect."
)
RULES = "Rows must be plausible as a whole and respect the relationships. Answer with data only, no code and no comments."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def example_object(cols: Sequence[str]) -> str:
    return "{" + ", ".join(f'"{c}": "<value>"' for c in cols) + "}"


def over_provisioned(n: int, groups: int, variant: str = "survival") -> int:
    """Chats to start so that about ``n`` survive all groups; the older variant multiplies by one to three."""
    if variant == "survival":
        return int(n / SURVIVING**groups)
    return n * max(1, min(groups // 2, 3))


def build_chats(
    cards: DataFrame | None,
    cols: Sequence[str],
    n: int,
    layout: str = "csv",
    spark=None,
    rows: int | None = None,
    system: bool = True,
) -> DataFrame:
    """``n`` copies of the opening chat.

    ``csv`` and ``json`` ask for whole rows in one go, from the cards of all columns; ``columnwise`` only opens the
    chat, and its turns follow per column group. Without ``system`` everything is in a single user message.
    ``rows`` are asked for, by default 25 lines or 20 objects.
    """
    rows = rows or (CSV_ROWS_ASKED if layout == "csv" else ROWS_ASKED)
    if layout == "columnwise":
        spark = spark or cards.sparkSession
        opening = F.array(message("system", F.lit(SYSTEM))) if system else F.array().cast(MESSAGES)
        return spark.range(n).select(F.col("id").alias("chat_id"), opening.cast(MESSAGES).alias("messages"))
    if layout == "csv":
        form = "one line per row, comma separated, in this column order:\n" + ",".join(cols)
    elif layout == "json":
        form = "one JSON object per row, like this with real values:\n" + example_object(cols)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    ordered = F.array_sort(F.collect_list(F.struct("position", "card")))
    sheet = cards.agg(F.array_join(F.transform(ordered, lambda c: c["card"]), "\n\n").alias("sheet"))
    request = F.concat(one_row(sheet)["sheet"], F.lit(f"\n\nWrite {rows} new rows. {RULES} Use {form}"))
    if system:
        messages = F.array(message("system", F.lit(SYSTEM)), message("user", request))
    else:
        messages = F.array(message("user", F.concat(F.lit(SYSTEM + "\n"), request)))
    return cards.sparkSession.range(n).select(F.col("id").alias("chat_id"), messages.alias("messages"))


def group_request(cards: Column, names: Column, known: Column, first: Column | bool, rows: int = ROWS_ASKED, system: bool = True) -> Column:
    """The user turn that asks for the next group: its cards, the task and the shape of an answer.

    Chats without a ``system`` message get its text with every turn.
    """
    earlier = F.lit("Copy the earlier columns of every row unchanged. ")
    first = F.lit(first) if isinstance(first, bool) else first
    example = F.concat(
        F.lit("{"), F.array_join(F.transform(known, lambda c: F.concat(F.lit('"'), c, F.lit('": "<value>"'))), ", "), F.lit("}")
    )
    return F.concat(
        F.lit("" if system else SYSTEM + "\n"), F.lit("Next columns: "), F.array_join(names, ", "), F.lit(".\n\n"), cards,
        F.lit(f"\n\nWrite {rows} rows with these columns. "), F.when(first, F.lit("")).otherwise(earlier),
        F.lit(RULES + " Use one JSON object per row, like this with real values:\n"), example,
    )


def column_groups(
    columns: DataFrame, edges: DataFrame, keys: Sequence[str] = (), order: str = "position", max_size: int = MAX_GROUP
) -> DataFrame:
    """``(keys, group_no, columns)``: greedy groups of columns without an edge inside.

    ``columns`` holds ``(keys, column, <order>)``. In order, each column joins the first group that has room and none
    of its neighbours. The fold runs inside Spark over one row per key.
    """
    neighbours = edges.groupBy(*keys, "column").agg(F.collect_set("other").alias("_near"))
    listed = columns.join(neighbours, [*keys, "column"], "left").withColumn(
        "_near", F.coalesce("_near", F.array().cast("array<string>"))
    )
    rows = listed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "column", F.col("_near").alias("near")))).alias("_c")
    )

    def place(groups: Column, c: Column) -> Column:
        fits = F.transform(groups, lambda g: (F.size(g) < max_size) & ~F.arrays_overlap(g, c["near"]))
        at = F.array_position(fits, True)
        grown = F.transform(groups, lambda g, i: F.when(i == at - 1, F.concat(g, F.array(c["column"]))).otherwise(g))
        return F.when(at == 0, F.concat(groups, F.array(F.array(c["column"])))).otherwise(grown)

    folded = F.aggregate("_c", F.array().cast("array<array<string>>"), place)
    return rows.select(*keys, F.posexplode(folded).alias("group_no", "columns"))


def complete_chats(
    chats: DataFrame, fn: Callable[[list[list[dict]]], list[str]], retries: int = 3
) -> DataFrame:
    """``(chat_id, response, error)`` from a user function that answers a batch of chats.

    A batch that raises is tried again; after ``retries`` failures its rows carry the error instead of a response.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            talks = [[{"role": m["role"], "content": m["content"]} for m in talk] for talk in pdf["messages"]]
            replies: list[str | None] = [None] * len(talks)
            error = None
            for _ in range(retries):
                try:
                    replies, error = list(fn(talks)), None
                    if len(replies) != len(talks):
                        raise ValueError(f"{len(replies)} replies to {len(talks)} chats")
                    break
                except Exception as e:  # noqa: BLE001 - any failure of the user's client is reported per row
                    replies, error = [None] * len(talks), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"chat_id": pdf["chat_id"], "response": replies, "error": error})

    return chats.select("chat_id", "messages").mapInPandas(answer, "chat_id bigint, response string, error string")


def rows_to_json(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    pretty: bool = True,
    shown: str | None = None,
) -> DataFrame:
    """``(keys, response)``: the rows of each key as JSON objects, one after the other in the given order.

    ``shown`` names an array column with the columns a row shows, in that order.
    """

    def inside(c: str) -> Column:
        col = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            # Spark writes large doubles with an exponent, which replies may not have.
            name = F.to_json(F.struct(F.lit(0).alias(c)))
            value = F.coalesce(plain_number(col.cast("double")), F.lit("null"))
            return F.concat(F.substring(name, F.lit(2), F.length(name) - 3), value)
        member = F.to_json(F.struct(col), {"ignoreNullFields": "false"})
        return F.substring(member, F.lit(2), F.length(member) - 2)

    if shown is None:
        members = F.array(*[inside(c) for c in cols])
    else:
        table = F.create_map(*[x for c in cols for x in (F.lit(c), inside(c))])
        members = F.transform(shown, lambda c: F.try_element_at(table, c))
    opening, sep, closing = ("{\n    ", ",\n    ", "\n}") if pretty else ("{", ",", "}")
    text = F.concat(F.lit(opening), F.array_join(members, sep), F.lit(closing))
    rows = df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in order]).alias("_o"), text.alias("_t"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_r"))
    return listed.select(*keys, F.array_join(F.transform("_r", lambda r: r["_t"]), "\n").alias("response"))


def trim_history(messages: Column, system: bool = True) -> Column:
    """Two finished turns become one: of five messages the first and the last two are kept, or of four without a
    ``system`` message the last two. A shorter or longer history stays."""
    places = (0, 3, 4) if system else (2, 3)
    kept = F.array(*[F.get(messages, F.lit(i)) for i in places])
    return F.when(F.size(messages) == (5 if system else 4), kept).otherwise(messages)


def route_chats(chats: DataFrame, replies: DataFrame, valid: DataFrame, normalised: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``(chat_id, messages, status)`` after one round.

    A chat with at least ``min_rows`` valid rows is ``accepted`` and ends with the normalised reply; any other one is
    ``retry``: it loses its last turn, and ``failed`` keeps that turn with the raw response.

    Every side has a row per chat and is joined by sorting: a plan takes texts for 20 bytes each, and would send those of
    hundreds of thousands of chats through the driver as a small table.
    """
    counts = valid.groupBy("chat_id").agg(F.count("*").alias("_rows"))
    joined = (
        chats.join(replies.hint("merge"), "chat_id", "left")
        .join(counts.hint("merge"), "chat_id", "left")
        .join(normalised.withColumnRenamed("response", "_normal").hint("merge"), "chat_id", "left")
    )
    good = F.coalesce(F.col("_rows") >= min_rows, F.lit(False))
    answered = F.concat("messages", F.array(message("assistant", F.col("_normal"))))
    shortened = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    failed = F.when(~good, F.concat("messages", F.array(message("assistant", F.col("response")))))
    return joined.select(
        "chat_id",
        F.when(good, answered).otherwise(shortened).alias("messages"),
        F.when(good, "accepted").otherwise("retry").alias("status"),
        failed.alias("failed"),
    )


def _part(turn: str, turns: int | None) -> Column:
    part = F.lit(0) if turns is None else F.floor(F.col(turn) / turns)
    return part.cast("bigint").alias("part")


def chat_to_text(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_text: int | None = None,
) -> DataFrame:
    """``(key, part, text)``: the messages of each chat in turn order as training text.

    A chat is one text, ``part`` 0, however long; a text is one value, so a task has to hold it. ``turns_per_text`` asks
    for texts of so many turns at most: a longer chat then continues in further parts.
    """
    line = F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), F.col(text))
    part = _part(turn, turns_per_text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("line"))))
    return df.groupBy(key, part).agg(F.array_join(F.transform(ordered, lambda m: m["line"]), "\n").alias("text"))


def collect_chats(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_chat: int | None = None,
) -> DataFrame:
    """``(key, part, messages)`` from a table of turns; a chat is one array, unless ``turns_per_chat`` cuts it in parts."""
    part = _part(turn, turns_per_chat)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return df.groupBy(key, part).agg(messages.alias("messages"))


def long_messages(chats: DataFrame, key: str = "chat_id") -> DataFrame:
    """``(key, turn, role, content)`` of chats with a message array."""
    return chats.select(key, F.posexplode("messages").alias("turn", "m")).select(
        key, F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"
    )
