"""Projections, filters, splits and casts that come before profiling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.ordering import ROWS_PER_PART, global_rank, hash_rank, part_count, spread
from tabweave.functions.seeded import HASH_SPAN, seeded_hash
from tabweave.operators.quantiles import values_at_ranks
from tabweave.roles import ROLE_TYPES, Roles, check_roles
from tabweave.session import durable

# A split that takes at most one in so many rows of a large table looks at the lowest hashes only.
FEW_ROWS = 4


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def split_code(df: DataFrame, col: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Split a compound code such as ``AA-123`` into one text column per name; a missing piece is null."""
    pieces = F.split(F.col(f"`{col}`"), "\\Q" + sep + "\\E")
    return df.withColumns({name: F.get(pieces, F.lit(i)) for i, name in enumerate(names)})


def recode(df: DataFrame, col: str, mapping: Mapping) -> DataFrame:
    """Replace codes by labels; a code without a label becomes null. The mapping is part of the plan."""
    if not mapping:
        return df.withColumn(col, F.lit(None).cast("string"))
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return df.withColumn(col, F.try_element_at(entries, F.col(f"`{col}`")))


def move_last(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if c != col], f"`{col}`")


def rename_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumnRenamed(target, "target")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep the rows without any null (or NaN)."""
    return df.na.drop("any")


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` from one pass with map-side partial sums."""
    sums = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return sums.select(F.inline(pairs))


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A full shuffle that is the same for every partitioning; ``key`` is unique."""
    return df.orderBy(seeded_hash(seed, *key), *key)


def _rank_order(df: DataFrame, order: Sequence[str] | None, key: Sequence[str] | None, seed: int):
    """A numeric leading column and the unique columns that break its ties; None where the lead is no number."""
    if order is None and key is None:
        raise ValueError("give an order or a key")
    if order is None:
        return seeded_hash(seed, *key), list(key)
    lead = df.schema[order[0]].dataType
    return (F.col(order[0]) if isinstance(lead, T.NumericType) else None), list(order)


def rank_intervals(
    df: DataFrame,
    ends: Sequence[int],
    order: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
    seed: int = 42,
    rows_per_part: int | None = None,
) -> DataFrame:
    """Add ``interval``: the number of ``ends`` below the 1-based rank of a row; ``ends`` ascend.

    Ranks follow a unique ``order`` or the seeded hash of a unique ``key``. A small table is ranked. Of a large one only
    the rows at the ends are looked up, and every row is then compared with them: no row is moved. Nulls rank first and
    NaN last, on either path.
    """
    rows = df.count()
    ends = [min(e, rows) for e in ends]
    lead, ties = _rank_order(df, order, key, seed)
    if part_count(rows, rows_per_part) == 1 or lead is None:
        ranked = (
            global_rank(df, order, "_rank", rows_per_part=rows_per_part)
            if order is not None
            else hash_rank(df, [], lead, ties, "_rank", rows_per_part=rows_per_part)
        )
        below = [F.when(F.col("_rank") > e, 1).otherwise(0) for e in ends]
        return ranked.withColumn("interval", sum(below, F.lit(0))).drop("_rank")
    wanted = sorted({e for e in ends if e > 0})
    # Nulls come first and NaN last, as in a sort; the ranks between are those of the numbers. Every pass below and every reader of
    # the result compares the lead, so it is hashed once and written: a filter would hash it once per comparison.
    tagged = durable(spread(df, rows, ties).withColumn("_lead", lead.cast("double")))
    nulls, numbers = tagged.agg(F.count_if(F.col("_lead").isNull()), F.count_if(F.col("_lead").isNotNull() & ~F.isnan("_lead"))).first()
    among = [e - nulls for e in wanted if nulls < e <= nulls + numbers]
    known = tagged.filter(F.col("_lead").isNotNull() & ~F.isnan("_lead"))
    found = dict(zip(among, values_at_ranks(known, F.col("_lead"), among, rows_per_part or ROWS_PER_PART) if among else []))
    leads = {e: found[e - nulls] if e - nulls in found else None if e <= nulls else math.nan for e in wanted}
    distinct = sorted(set(found.values()))
    before = tagged.agg(*[F.count_if(F.col("_lead") < v).alias(f"b{i}") for i, v in enumerate(distinct)]).first() if distinct else ()
    first = {v: nulls + n for v, n in zip(distinct, before)}

    def same(value: float | None) -> Column:
        if value is None:
            return F.col("_lead").isNull()
        return F.col("_lead").isNotNull() & (F.isnan("_lead") if math.isnan(value) else F.col("_lead") == value)

    def above(value: float | None) -> Column:
        # Spark compares NaN as the largest number.
        return F.col("_lead").isNotNull() if value is None else F.coalesce(F.col("_lead") > F.lit(value), F.lit(False))

    # Rows that share the lead of an end are ranked among themselves by their key, in parts if they are many.
    marks = {}
    for value in {None if v is None else repr(v): v for v in leads.values()}.values():
        mine = [e for e in wanted if repr(leads[e]) == repr(value)]
        start = 0 if value is None else nulls + numbers if math.isnan(value) else first[value]
        tied = global_rank(tagged.filter(same(value)).select(*ties), ties, "_at", rows_per_part=rows_per_part)
        for row in tied.filter(F.col("_at").isin([e - start for e in mine])).collect():
            marks[row["_at"] + start] = row

    def place(values: Mapping[str, Column]) -> Column:
        # A null sorts before any value.
        return F.struct(*[x for c in ties for x in (values[c].isNotNull().alias(f"k_{c}"), values[c].alias(c))])

    def beyond(e: int) -> Column:
        if e == 0:
            return F.lit(1)
        last = place({c: F.lit(marks[e][c]).cast(df.schema[c].dataType) for c in ties})
        later = same(leads[e]) & (place({c: F.col(c) for c in ties}) > last)
        return F.when(above(leads[e]) | later, 1).otherwise(0)

    return tagged.withColumn("interval", sum([beyond(e) for e in ends], F.lit(0))).drop("_lead")


def _lowest(df: DataFrame, count: int, rows: int, key: Sequence[str], seed: int) -> DataFrame:
    """The rows with seeded hashes below a bound that holds the first ``count`` of them, or all rows.

    Hashes are uniform, so little more than the rows wanted lies below the bound; whether they all do is counted.
    """
    share = (count + 8 * math.sqrt(count) + 100) / rows
    low = durable(df.filter(seeded_hash(seed, *key) < math.ceil(share * HASH_SPAN)))
    return low if low.count() >= count else df


def train_test_split(
    df: DataFrame,
    n_train: int,
    n_test: int,
    order: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
    seed: int = 42,
    rows_per_part: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Mark the first ``n_train`` rows ``train`` and the next ``n_test`` rows ``test``; drop the rest.

    Sizes are capped at 75 % and 25 % of the rows. Rows are taken in a given ``order``, or in seeded hash order of ``key``.
    ``dealt`` says that a large ``df`` lies in enough files already.
    """
    rows = df.count()
    train, test = min(n_train, int(rows * 0.75)), min(n_test, int(rows * 0.25))
    if order is None and key is not None and part_count(rows, rows_per_part) > 1 and (train + test) * FEW_ROWS <= rows:
        df = _lowest(df if dealt else spread(df, rows, key), train + test, rows, key, seed)
    cut = rank_intervals(df, [train, train + test], order, key, seed, rows_per_part)
    kept = cut.filter(F.col("interval") < 2)
    return kept.withColumn("split", F.when(F.col("interval") == 0, "train").otherwise("test")).drop("interval")


def repetition_slices(
    df: DataFrame, size: int, repetitions: int, order: Sequence[str], rows_per_part: int | None = None
) -> DataFrame:
    """Cut generated rows into ``repetitions`` slices of ``size`` rows; the tail is discarded."""
    cut = rank_intervals(df, [size * (i + 1) for i in range(repetitions)], order, rows_per_part=rows_per_part)
    kept = cut.filter(F.col("interval") < repetitions)
    return kept.withColumn("repetition", F.col("interval").cast("bigint")).drop("interval")


def cast_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Cast every column to its role; text that is no number becomes null and int casts truncate."""
    check_roles(roles)

    def cast(c: str, role: str):
        col = F.col(f"`{c}`")
        if role == "int":
            return col.try_cast("double").try_cast("bigint") if df.schema[c].dataType.typeName() not in (
                "byte", "short", "integer", "long") else col.cast("bigint")
        return col.try_cast(ROLE_TYPES[role])

    return df.select(*[cast(c, roles[c]).alias(c) if c in roles else F.col(f"`{c}`") for c in df.columns])


def drop_random_columns(keys: DataFrame, key: str, cols: Sequence[str], target: str, seed: int = 42) -> DataFrame:
    """``(key, column)`` of the columns each key keeps: a random 0 to half of them go, never the target."""
    most = len(cols) // 2
    n_drop = F.floor(F.col("_u") * (most + 1)).cast("int")
    hashed = F.array_sort(
        F.array(
            *[F.struct(seeded_hash(seed, key, F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in cols if c != target]
        )
    )
    drawn = keys.select(key, (seeded_hash(seed, key, F.lit("columns")) / F.lit(float(16**13))).alias("_u"), hashed.alias("_c"))
    kept = F.concat(F.transform(F.slice("_c", n_drop + 1, len(cols)), lambda s: s["c"]), F.array(F.lit(target)))
    return drawn.select(key, F.explode(kept).alias("column"))
