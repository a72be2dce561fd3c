"""Ranks and running totals over whole tables without an unpartitioned window.

A window without (or with few) partition keys sorts everything in one task. Here rows are dealt to parts by ranges of
their order, or of a seeded hash; each part is summed up by itself and the totals of the parts before it are joined to it.
Where the ranges are cut only steers the work: any cuts give the same ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.seeded import HASH_SPAN
from tabweave.session import durable

PART = "_part"

# Rows one window task may be given before the order range is cut.
ROWS_PER_PART = 2_000_000
# Rows of a task of a large table that is written to be read many times.
ROWS_PER_TASK = 500_000
# Parts that smaller ones may come to: each is a task, and the rows, not their number, should decide what a rank costs.
SMALL_PARTS = 64
# Cuts up to which the search is spelled out in generated code.
INLINE_CUTS = 255
SAMPLES_PER_PART = 30


def part_count(rows: int, rows_per_part: int | None = None) -> int:
    """Parts of so many rows at most; once there are ``SMALL_PARTS``, smaller parts than ``ROWS_PER_PART`` grow instead."""
    wanted = math.ceil(rows / (rows_per_part or ROWS_PER_PART))
    return max(1, min(wanted, max(SMALL_PARTS, math.ceil(rows / ROWS_PER_PART))))


def spread(df: DataFrame, rows: int, key: Sequence[str]) -> DataFrame:
    """``df`` dealt to tasks by its key: a file of one row group comes as one task, however large."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in key])


def in_order_parts(df: DataFrame, order: Sequence[str], most: int, rows_per_part: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with its part in ``PART``, rising along ``order``, and whether there are several.

    ``most`` is a bound of the number of rows that is cheap to know. Only beyond what one task can hold is ``df`` written,
    counted and dealt to ranges; no cut point passes through the plan, so the number of parts has no limit.
    """
    if part_count(most, rows_per_part) == 1:
        return df.withColumn(PART, F.lit(0)), False
    held = durable(df)
    parts = part_count(held.count(), rows_per_part)
    if parts == 1:
        return held.withColumn(PART, F.lit(0)), False
    # Written with the part, since another run of the same range partitioning may cut elsewhere.
    return durable(held.repartitionByRange(parts, *[F.col(f"`{c}`") for c in order]).withColumn(PART, F.spark_partition_id())), True


def _spread(points: list, parts: int) -> list:
    """``parts - 1`` evenly spaced, distinct members of a sorted list."""
    picked = [points[len(points) * i // parts] for i in range(1, parts)] if points else []
    return [p for i, p in enumerate(picked) if i == 0 or p != picked[i - 1]]


def part_of(key: Column, cuts: Sequence[Column]) -> Column:
    """Number of the sorted ``cuts`` at or below ``key``, by binary search.

    Few cuts become nested conditions inside generated code; many become a search in a literal array.
    """
    if not cuts:
        return F.lit(0)
    if len(cuts) <= INLINE_CUTS:
        return _branch(key, cuts, 0, len(cuts))
    bounds = F.array(*cuts)
    steps = [2**i for i in reversed(range(len(cuts).bit_length()))]

    def advance(found: Column, step: Column) -> Column:
        further = found + step
        fits = (further <= len(cuts)) & (F.get(bounds, further - 1) <= key)
        return F.when(fits, further).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _branch(key: Column, cuts: Sequence[Column], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(cuts[middle] <= key, _branch(key, cuts, middle + 1, high)).otherwise(_branch(key, cuts, low, middle))


def value_cuts(df: DataFrame, cols: Sequence[str], parts: int) -> dict[str, list]:
    """Sampled cut points of each column for about so many parts; they become literals, so ``parts`` has to be bounded."""
    rows = df.count()
    if parts == 1 or rows == 0:
        return {c: [] for c in cols}
    fraction = min(1.0, SAMPLES_PER_PART * parts / rows)
    sample = df.select(*[F.col(f"`{c}`").alias(c) for c in cols]).sample(fraction, seed=7).collect()
    # A value that differs from itself is NaN, which Python cannot sort.
    return {c: _spread(sorted(r[i] for r in sample if r[i] is not None and r[i] == r[i]), parts) for i, c in enumerate(cols)}


def hash_part(hashed: Column, parts: int) -> Column:
    """Part of a seeded hash; hashes are uniform, so equal ranges are equal parts."""
    return F.floor(hashed / F.lit(HASH_SPAN / parts)).cast("int")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    amounts: dict[str, Column | str],
    totals: dict[str, str] | None = None,
    split: bool = True,
    last: tuple[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of some ``amounts`` per group; ``df`` carries the part of each row in ``PART``.

    ``totals`` names the sums of whole groups, by the name of the amount. ``last = (column, name)`` adds the greatest value of a
    column in the parts before, null in the first one. ``split=False`` says that every row is in part 0.
    """
    amounts = {n: F.col(a) if isinstance(a, str) else a for n, a in amounts.items()}
    totals = totals or {}
    own = [*group, PART] if split else [*group]
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    out = df.withColumns({n: F.sum(a).over(inside) for n, a in amounts.items()})
    if not split:
        out = out.withColumns({t: F.sum(amounts[n]).over(whole) for n, t in totals.items()})
        return out.withColumn(last[1], F.lit(None).cast(df.schema[last[0]].dataType)) if last else out
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, PART).agg(*[F.sum(a).alias(f"_sum_{n}") for n, a in amounts.items()], *([F.max(last[0]).alias("_last")] if last else []))
    # One row per group and part.
    shift = sums.select(
        *group,
        PART,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in amounts],
        *[F.sum(f"_sum_{n}").over(whole).alias(t) for n, t in totals.items()],
        *([F.max("_last").over(before).alias(last[1])] if last else []),
    )
    out = out.join(shift, [*group, PART]).withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in amounts})
    return out.drop(*[f"_before_{n}" for n in amounts])


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], amount: Column | str, name: str, total: str | None = None, split: bool = True
) -> DataFrame:
    """One of ``running_totals``; ``total`` adds the sum of the whole group."""
    return running_totals(df, group, order, {name: amount}, {name: total} if total else None, split)


def global_rank(
    df: DataFrame, order: Sequence[str], name: str, total: str | None = None, rows_per_part: int | None = None
) -> DataFrame:
    """1-based position of every row in the order of a unique key; ``total`` adds the row count."""
    tagged, split = in_order_parts(df, order, df.count(), rows_per_part)
    return running_total(tagged, [], order, F.lit(1).cast("bigint"), name, total, split).drop(PART)


def hash_rank(
    df: DataFrame,
    group: Sequence[str],
    hashed: Column,
    key: Sequence[str],
    name: str,
    total: str | None = None,
    rows_per_part: int | None = None,
) -> DataFrame:
    """1-based position in the order of a seeded hash, per group; a hot group is spread over all parts."""
    parts = part_count(df.count(), rows_per_part)
    tagged = df.withColumn("_hash", hashed).withColumn(PART, hash_part(F.col("_hash"), parts))
    out = running_total(tagged, group, ["_hash", *key], F.lit(1).cast("bigint"), name, total, parts > 1)
    return out.drop("_hash", PART)
