"""A fine-tuning corpus: many conversations, each about its own columns and its own sample of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.seeded import seeded_hash, unit
from tabweave.operators import association, cards, profile, shifts
from tabweave.operators import chats as C
from tabweave.operators.prepare import drop_random_columns, rank_intervals
from tabweave.operators.sampling import add_noise, sample_rows_per_key
from tabweave.roles import Roles, cat_cols, cont_cols
from tabweave.session import durable

KEY = "conv_id"
# Profile sample size and share, example rows per conversation, every how manieth one is for evaluation.
SAMPLE_ROWS, SAMPLE_SHARE = 500, 0.75
FEWEST_EXAMPLES, MOST_EXAMPLES = 20, 25
EVAL_EVERY = 5


def conversation_count(num_examples: int | None) -> int:
    """250 conversations for a budget below 75 example rows, 500 for any other, 750 for all rows (None)."""
    if num_examples is None:
        return 750
    return 250 if num_examples < 75 else 500


def split_of(key: Column) -> Column:
    return F.when(F.pmod(key, F.lit(EVAL_EVERY)) == 0, "eval").otherwise("train")


def conversation_samples(
    df: DataFrame, row_key: Sequence[str], n: int, seed: int, rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE
) -> DataFrame:
    """``(conv_id, draw, columns...)``: each conversation's own ``rows`` to profile, at most a ``share`` of the table."""
    size = min(rows, int(df.count() * share))
    keys = df.sparkSession.range(n).select(F.col("id").alias(KEY), F.lit(size).alias("size"))
    return sample_rows_per_key(df, row_key, keys, KEY, "size", seed)


def conversation_examples(
    df: DataFrame, row_key: Sequence[str], n: int, num_examples: int | None, seed: int
) -> DataFrame:
    """``(conv_id, draw, columns...)``: 20 to 25 rows out of the first ``num_examples`` shuffled rows, or of all (None)."""
    pool = df
    if num_examples is not None:
        pool = rank_intervals(df, [num_examples], key=row_key, seed=seed).filter(F.col("interval") == 0).drop("interval")
    span = MOST_EXAMPLES - FEWEST_EXAMPLES + 1
    size = FEWEST_EXAMPLES + F.floor(unit(seed, "id", F.lit("examples")) * span)
    keys = df.sparkSession.range(n).select(F.col("id").alias(KEY), size.alias("size"))
    return sample_rows_per_key(pool, row_key, keys, KEY, "size", seed + 1)


def _kept_only(df: DataFrame, kept: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.join(kept.withColumnRenamed("column", name), [KEY, name], "left_semi")
    return df


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, group_no, split, messages)``: one chat per column group.

    ``turns`` holds ``(conv_id, group_no, request, response)``. Each chat has the system message, the turn before (a
    longer history is trimmed) and its own turn.
    """
    # Joined on conversation and group rather than read over a window: a long conversation stays spread.
    earlier = turns.select(
        KEY, (F.col("group_no") + 1).cast(turns.schema["group_no"].dataType).alias("group_no"),
        F.col("request").alias("_request"), F.col("response").alias("_response"),
    )
    before = turns.join(earlier, [KEY, "group_no"], "left")
    own = F.array(C.message("user", F.col("request")), C.message("assistant", F.col("response")))
    last = F.array(C.message("user", F.col("_request")), C.message("assistant", F.col("_response")))
    opening = F.array(C.message("system", F.lit(C.SYSTEM)))
    messages = F.when(F.col("_request").isNull(), F.concat(opening, own)).otherwise(F.concat(opening, last, own))
    return before.select(KEY, "group_no", split_of(F.col(KEY)).alias("split"), messages.alias("messages"))


def build_corpus(
    df: DataFrame,
    roles: Roles,
    target: str,
    row_key: Sequence[str],
    num_examples: int | None = 50,
    conversations: int | None = None,
    descriptions: dict[str, str] | None = None,
    stats: Sequence[str] = cards.DEFAULT_STATS,
    shapes: bool = True,
    seed: int = 42,
    sample_rows: int = SAMPLE_ROWS,
    sample_share: float = SAMPLE_SHARE,
) -> DataFrame:
    """Conversations over complete rows, every growing prefix as a chat of its own.

    Each conversation profiles ``sample_rows`` rows, at most a ``sample_share`` of the table, and shows rows out of the
    first ``num_examples`` shuffled ones, or out of all (None).

    All conversations are built side by side: after one scan that draws their rows, everything is grouped by
    conversation, and no step depends on the size of the table.
    """
    n = conversations or conversation_count(num_examples)
    rows = df.select(*row_key, *[f"`{c}`" for c in roles if c not in row_key]).na.drop("any")
    cats, conts = cat_cols(roles), cont_cols(roles)
    spark = df.sparkSession

    kept = durable(drop_random_columns(spark.range(n).withColumnRenamed("id", KEY), KEY, list(roles), target, seed))
    sample = durable(conversation_samples(rows, row_key, n, seed, sample_rows, sample_share))
    examples = durable(conversation_examples(rows, row_key, n, num_examples, seed))

    by = [KEY]
    edges = durable(_kept_only(association.association_edges(sample, roles, keys=by), kept, "column", "other"))
    placed = kept.withColumn("place", seeded_hash(seed, KEY, "column", F.lit("order")))
    groups = durable(C.column_groups(placed, edges, by, order="place"))
    members = groups.select(KEY, "group_no", F.posexplode("columns").alias("at", "column"))

    bodies = []
    numeric = None
    if conts:
        numeric = durable(_kept_only(profile.numeric_profile(sample, conts, by), kept, "column"))
        shape = profile.fit_distribution(sample, conts, by, profile=numeric) if shapes else None
        modes = profile.fit_modes(sample, conts, by, profile=numeric) if shapes else None
        bodies.append(cards.numeric_card(numeric, stats, by, shape, modes))
    if cats:
        labels = _kept_only(profile.category_profile(sample, cats, by), kept, "column")
        bodies.append(cards.category_card(labels, "percent", by, order="value"))
    body = bodies[0] if len(bodies) == 1 else bodies[0].unionByName(bodies[1])

    relations = None
    if "correlations" in stats:
        numbers = members.select(KEY, "column", "group_no")
        theirs = numbers.select(KEY, F.col("column").alias("other"), F.col("group_no").alias("_other_no"))
        earlier = (
            edges.join(numbers, [KEY, "column"]).join(theirs, [KEY, "other"]).filter(F.col("_other_no") <= F.col("group_no"))
        ).select(KEY, "column", "other")
        by_cat = shifts.cat_given_cat(sample, edges, roles, by)
        by_cont = shifts.cat_given_cont(sample, edges, roles, by)
        by_label = shifts.cont_given_cat(sample, edges, roles, by)
        relations = cards.relationship_card(edges, by_cat.unionByName(by_cont), by_label, roles, by, allowed=earlier)
    sheet = cards.column_card(body, roles, by, relations, descriptions)

    ordered = F.array_sort(F.collect_list(F.struct("at", "card")))
    sheets = sheet.join(members, [KEY, "column"]).groupBy(KEY, "group_no").agg(
        F.array_join(F.transform(ordered, lambda c: c["card"]), "\n\n").alias("sheet")
    )
    upto = Window.partitionBy(KEY).orderBy("group_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = groups.withColumn("known", F.flatten(F.collect_list("columns").over(upto)))
    requests = sheets.join(known, [KEY, "group_no"]).select(
        KEY, "group_no", "known",
        C.group_request(F.col("sheet"), F.col("columns"), F.col("known"), F.col("group_no") == 0).alias("request"),
    )

    floats = [c for c, r in roles.items() if r == "float"]
    if floats and numeric is not None:
        examples = add_noise(examples, numeric.select(KEY, "column", "std"), floats, ["draw"], by, seed=seed)
        # A dropped column has no profile; its noise is undefined, and it is not shown either.
    shown = examples.join(known.select(KEY, "group_no", "known"), KEY)
    responses = C.rows_to_json(shown, list(roles), [KEY, "group_no"], ["draw"], shown="known")
    turns = requests.join(responses, [KEY, "group_no"]).select(KEY, "group_no", "request", "response")
    return prefixes(turns)
