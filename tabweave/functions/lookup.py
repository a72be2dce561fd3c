"""Dictionary lookups that stay safe for dictionaries and columns of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A dictionary of at most this many entries is sent to every executor.
BROADCAST_ENTRIES = 100_000
# Longer texts count as several entries, which bounds a broadcast dictionary at 50 MB.
ENTRY_BYTES = 500
# An entry is hot above this share of the rows; at most 1 / HOT_SHARE entries can be hot.
HOT_SHARE = 0.001
# Rows without a key are spread over this many.
SALTS = 10_000


def long_values(cols: Sequence[str], kind: str = "string") -> Column:
    """An array of ``(column, value)`` structs to explode."""
    return F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols]
    )


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct, usable in any expression without a join."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()


def small_side(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tables with a row per column, or pair of columns, are bounded by the schema and broadcast; with keys they are not."""
    return df if keys else F.broadcast(df)


def lookup(
    df: DataFrame, col: str, entries: DataFrame, key: str, value: str, out: str, size: int, weight: str | None = None
) -> DataFrame:
    """Left lookup of ``df[col]`` in ``entries[key]``.

    ``size`` is the checked number of entries. A small dictionary is broadcast. Of a large one only the hot entries are
    (there are at most ``1 / HOT_SHARE``, since the ``weight`` counts sum to the total); the other rows, none of them
    hot, are joined by shuffle. ``df`` is read once either way.
    """
    table = entries.select(F.col(key).alias("_key"), F.col(value).alias("_found"), *([weight] if weight else []))
    slim = table.select("_key", "_found")
    match = F.col(f"`{col}`").cast("string") == F.col("_key")

    def finish(joined: DataFrame) -> DataFrame:
        return joined.withColumn("_result", F.col("_found")).drop("_key", "_found")

    if size <= BROADCAST_ENTRIES:
        done = finish(df.join(F.broadcast(slim), match, "left"))
    elif weight is None:
        done = finish(df.join(slim, match, "left"))
    else:
        least = table.agg((F.sum(weight) * HOT_SHARE).alias("least")).scalar()
        hot = table.filter(F.col(weight) >= least).select(F.col("_key").alias("_hot_key"), F.col("_found").alias("_hot_found"))
        probe = F.col(f"`{col}`").cast("string")
        first = df.join(F.broadcast(hot), probe == F.col("_hot_key"), "left")
        # Rows that are done, and nulls, which match nothing, go along without a key, spread by a salt.
        waits = F.col("_hot_key").isNull() & probe.isNotNull()
        first = first.withColumns({
            "_probe": F.when(waits, probe),
            "_salt": F.when(waits, F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).cast("bigint"),
        })
        rest = slim.withColumn("_zero", F.lit(0).cast("bigint"))
        joined = first.join(rest, (F.col("_probe") == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
        joined = joined.withColumn("_found", F.coalesce("_hot_found", "_found"))
        done = finish(joined.drop("_hot_key", "_hot_found", "_probe", "_salt", "_zero"))
    names = [F.col("_result").alias(out) if c == out else F.col(f"`{c}`") for c in df.columns]
    if out not in df.columns:
        names.append(F.col("_result").alias(out))
    return done.select(*names)
