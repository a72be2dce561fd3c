"""Rows from a model: ask, parse, validate, top up.

The model is any function from a batch of chats to replies. The driver only controls the loop; chats, replies and rows
are tables, and every round is written to the checkpoint folder, so a lost executor repeats its tasks and not the calls
of earlier rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import one_row
from tabweave.functions.ordering import global_rank
from tabweave.operators import chats as C
from tabweave.operators import replies as R
from tabweave.operators.cards import DEFAULT_STATS
from tabweave.operators.dictionary import decode, dictionary_sizes
from tabweave.plans.profiling import VARIANTS, TableProfile, profile_cards
from tabweave.session import durable

Model = Callable[[list[list[dict]]], list[str]]

# Rows a chat is first expected to give, share of chats that may be dropped, rounds without progress.
ROWS_PER_CHAT = 16
ALLOWED_DROPOUT = 0.2
STUCK_ROUNDS = 3


@dataclass(frozen=True)
class Batch:
    """Accepted ``rows`` (``chat_id, position, columns...``, categories as codes) and the chats that failed."""

    rows: DataFrame
    failed: DataFrame | None
    chats: int


def _sheet(cards: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "card")))
    return cards.agg(F.array_join(F.transform(ordered, lambda c: c["card"]), "\n\n").alias("sheet"))


def _validated(parsed: DataFrame, p: TableProfile, cols: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    roles = {c: p.roles[c] for c in cols}
    return R.accepted(R.validate_rows(parsed, p.numeric, p.dictionary, roles, sizes))


def one_shot_batch(p: TableProfile, fn: Model, n: int, variant: str = "basic", system: bool = True, **card_options) -> Batch:
    """One round of ``n`` chats that each answer with whole rows."""
    layout = VARIANTS[variant]["layout"]
    cols = list(p.roles)
    asked = C.build_chats(profile_cards(p, variant, **card_options), cols, n, layout, system=system)
    replies = durable(C.complete_chats(asked, fn))
    parsed = R.parse_csv_replies(replies, cols) if layout == "csv" else R.parse_json_replies(replies, cols, exact=True)
    return Batch(durable(_validated(parsed, p, cols, dictionary_sizes(p.dictionary))), None, n)


def generation_groups(p: TableProfile) -> list[list[str]]:
    """Column groups in ascending order of association count; a list no longer than the schema."""
    spark = p.edges.sparkSession
    columns = spark.createDataFrame(list(enumerate(p.roles)), "place int, column string")
    degree = p.edges.groupBy("column").agg(F.count("*").alias("_d"))
    ordered = columns.join(degree, "column", "left").select(
        "column", F.struct(F.coalesce("_d", F.lit(0)).alias("d"), "place").alias("rank")
    )
    found = C.column_groups(ordered, p.edges, order="rank").orderBy("group_no").collect()
    return [list(r["columns"]) for r in found]


def columnwise_batch(
    p: TableProfile,
    fn: Model,
    n: int,
    variant: str = "columnwise_relationships_json",
    min_rows: int = C.MIN_ROWS,
    system: bool = True,
    **card_options,
) -> Batch:
    """One batch of chats that grow the rows group by group.

    Chats whose reply has too few valid rows repeat the turn until at most a fifth of them is left or three rounds
    bring nothing; the remaining ones are dropped.
    """
    groups = generation_groups(p)
    sizes = dictionary_sizes(p.dictionary)
    spark = p.edges.sparkSession
    started = C.over_provisioned(n, len(groups))
    good = C.build_chats(None, list(p.roles), started, "columnwise", spark, system=system)
    known: list[str] = []
    rows, failed = None, []
    for number, group in enumerate(groups):
        known += group
        pairs = spark.createDataFrame([(a, b) for a in group for b in known if a != b] or [("", "")], "column string, other string")
        cards = profile_cards(p, variant, allowed=pairs, **card_options).filter(F.col("column").isin(group))
        request = C.group_request(
            one_row(durable(_sheet(cards)))["sheet"],
            F.array(*[F.lit(c) for c in group]),
            F.array(*[F.lit(c) for c in known]),
            number == 0,
            system=system,
        )
        waiting = durable(good.withColumn("messages", C.trim_history(F.col("messages"), system)))
        ready, n_waiting, n_ready, stuck = [], waiting.count(), 0, 0
        rows_parts = []
        while n_waiting / max(1, n_waiting + n_ready) > ALLOWED_DROPOUT and stuck < STUCK_ROUNDS:
            asked = waiting.withColumn("messages", F.concat("messages", F.array(C.message("user", request))))
            replies = durable(C.complete_chats(asked, fn))
            valid = durable(_validated(R.parse_json_replies(replies, known), p, known, sizes))
            texts = decode(valid, p.dictionary, {c: p.roles[c] for c in known}, sizes)
            normalised = C.rows_to_json(texts, known, ["chat_id"], ["position"])
            routed = durable(C.route_chats(asked, replies, valid, normalised, min_rows))
            accepted = routed.filter("status = 'accepted'").select("chat_id", "messages")
            waiting = routed.filter("status = 'retry'").select("chat_id", "messages")
            failed.append(routed.filter("failed is not null").select("chat_id", "failed"))
            rows_parts.append(valid.join(accepted.select("chat_id").hint("merge"), "chat_id", "left_semi"))
            ready.append(accepted)
            gained = accepted.count()
            n_ready += gained
            n_waiting = waiting.count()
            stuck = stuck + 1 if gained == 0 else 0
        if not ready or n_ready == 0:
            return Batch(spark.createDataFrame([], _row_schema(p)), _all(failed), started)
        good = _all(ready)
        rows = _all(rows_parts)
    return Batch(durable(rows.select("chat_id", "position", *[f"`{c}`" for c in p.roles])), _all(failed), started)


def _all(parts: Sequence[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def _row_schema(p: TableProfile) -> str:
    kinds = {"str": "bigint", "int": "bigint", "float": "double"}
    return ", ".join(["chat_id bigint", "position int", *[f"`{c}` {kinds[r]}" for c, r in p.roles.items()]])


def generate_rows(
    p: TableProfile,
    fn: Model,
    count: int,
    variant: str = "basic",
    stats: Sequence[str] = DEFAULT_STATS,
    descriptions: dict[str, str] | None = None,
    no_stats: bool = False,
    rows_per_part: int | None = None,
    system: bool = True,
) -> DataFrame:
    """``(batch, chat_id, position, columns...)``: exactly ``count`` accepted rows, the earliest ones.

    ``system=False`` is for models that take no system message: its text goes into the user turns.

    The first batch assumes sixteen rows per chat; later ones ask for what is missing at the rate seen so far. Three
    batches without a single row are an error.
    """
    options = {"stats": stats, "descriptions": descriptions, "no_stats": no_stats, "system": system}
    make = columnwise_batch if VARIANTS[variant]["layout"] == "columnwise" else one_shot_batch
    batches: list[DataFrame] = []
    have = chats = empty = 0
    needed = math.ceil(count / ROWS_PER_CHAT)
    while have < count:
        batch = make(p, fn, needed, variant, **options)
        gained = batch.rows.count()
        chats += needed
        have += gained
        empty = empty + 1 if gained == 0 else 0
        if empty >= STUCK_ROUNDS:
            raise RuntimeError(f"no valid row in {STUCK_ROUNDS} batches; {have} of {count} rows so far")
        batches.append(batch.rows.withColumn("batch", F.lit(len(batches))))
        rate = max(1, have // chats)
        needed = math.ceil((count - have) / rate)
    whole = _all(batches)
    ranked = global_rank(whole, ["batch", "chat_id", "position"], "_rank", rows_per_part=rows_per_part)
    return ranked.filter(F.col("_rank") <= count).select("batch", "chat_id", "position", *[f"`{c}`" for c in p.roles])
