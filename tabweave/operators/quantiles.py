"""Exact percentiles with linear interpolation, without sorting or buffering a whole column.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer; it serves small tables. For a large
table without keys, a sample brackets each wanted rank, one aggregation counts the rows below and inside the brackets,
and only the rows inside are counted by value. With keys, the value range is cut into parts, and only the parts that
hold a wanted rank are sorted. Both are exact: brackets that miss are widened, and counts decide, not the sample.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.ordering import PART, ROWS_PER_PART, part_count, part_of, value_cuts

# The profiled percentiles.
PERCENTILES = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}

# Rows up to which Spark's own percentile is used; with keys the rows are spread over the groups.
BUFFERED_ROWS, BUFFERED_KEYED_ROWS = 100_000, ROWS_PER_PART
# Rows sampled per round, and the width of a bracket in standard deviations of a sampled rank.
SAMPLE_ROWS, BRACKET_WIDTH = 50_000, 6.0
# Rows of one bracket that are sorted in one task; more are bracketed again.
BRACKET_ROWS = 500_000
# Parts of the value range out of which percentiles per key are selected.
SELECTION_PARTS = 64
MAX_SELECTION_PARTS = 4096


def as_double(c: str) -> Column:
    """A column as double; NaN counts as missing."""
    return F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))


def buffered(df: DataFrame, keys: Sequence[str] = (), rows_per_part: int | None = None) -> bool:
    return df.count() <= (rows_per_part or (BUFFERED_KEYED_ROWS if keys else BUFFERED_ROWS))


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    points: Mapping[str, float] = PERCENTILES,
    rows_per_part: int | None = None,
) -> DataFrame:
    """``(keys, column, points...)`` for a table of any size."""
    if keys:
        return quantiles_by_parts(df, cols, keys, points, rows_per_part)
    return quantiles_by_brackets(df, cols, points, rows_per_part or BRACKET_ROWS)


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), rows_per_part: int | None = None) -> DataFrame:
    """``(keys, column, p50)``."""
    if not buffered(df, keys, rows_per_part):
        return exact_quantiles(df, cols, keys, {"p50": 0.5}, rows_per_part)
    wide = df.groupBy(*keys).agg(*[F.median(as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("p50")) for i, c in enumerate(cols)]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def exact_percentile(df: DataFrame, col: str, p: float, name: str, rows_per_part: int | None = None) -> DataFrame:
    """One exact percentile of one column."""
    return exact_quantiles(df, [col], (), {name: p}, rows_per_part).select(name)


@dataclass
class Bracket:
    """Bounds, inclusive, of the values at ranks ``floor(at)`` and ``ceil(at)`` of a column."""

    col: int
    name: str
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0
    at: float = 0.0
    settled: bool = False

    def condition(self, x: Column) -> Column:
        # NaN is above infinity for Spark, so the upper bound keeps it out.
        inside = x <= F.lit(self.high)
        return inside & (x >= F.lit(self.low)) if self.low > -math.inf else inside

    def narrow(self, sample: np.ndarray) -> None:
        """Bounds around the wanted rank from a sorted sample of the values inside the present bounds."""
        if len(sample) == 0 or self.inside == 0:
            return
        share = min(max((self.at - self.below) / self.inside, 0.0), 1.0)
        centre = share * (len(sample) - 1)
        margin = BRACKET_WIDTH * math.sqrt(len(sample) * share * (1 - share)) + 10
        first, last = math.floor(centre - margin), math.ceil(centre + margin)
        self.low = float(sample[first]) if first >= 0 else self.low
        self.high = float(sample[last]) if last < len(sample) else self.high

    def holds(self) -> bool:
        return self.below <= math.floor(self.at) and math.ceil(self.at) < self.below + self.inside


def quantiles_by_brackets(
    df: DataFrame, cols: Sequence[str], points: Mapping[str, float] = PERCENTILES, bracket_rows: int = BRACKET_ROWS
) -> DataFrame:
    """Exact percentiles of whole columns: a sample, a counting pass and a pass over the few rows near each rank."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    x = [F.col(f"_x{i}") for i in range(len(cols))]
    rows = numbers.agg(*[F.count_if(c <= math.inf).alias(f"n{i}") for i, c in enumerate(x)]).first()
    brackets = [
        Bracket(i, n, inside=rows[i], at=p * (rows[i] - 1)) for i in range(len(cols)) for n, p in points.items() if rows[i]
    ]
    _narrow(numbers, x, rows, brackets, bracket_rows)
    return _pick(numbers, x, cols, brackets, points)


def _narrow(
    numbers: DataFrame, x: Sequence[Column], rows: Sequence[int], brackets: Sequence[Bracket], bracket_rows: int
) -> None:
    """Tighten the brackets until each holds few rows or few distinct values."""
    open_ = [b for b in brackets if b.inside > bracket_rows]
    for _ in range(20):
        if not open_:
            break
        # Only rows that some open bracket still holds are sampled, so that every round brings new detail.
        pool = numbers.filter(_any([b.condition(x[b.col]) for b in open_]))
        held = min(max(b.inside for b in open_) * len(open_), max(rows))
        sample = pool.sample(min(1.0, SAMPLE_ROWS / held), seed=7).toArrow()
        values = [np.sort(sample.column(i).drop_null().to_numpy()) for i in range(len(x))]
        for b in open_:
            v = values[b.col]
            v = v[~np.isnan(v)]
            before = (b.low, b.high)
            b.narrow(v[(v >= b.low) & (v <= b.high)])
            # Bounds that stay hold few distinct values, which are counted by value as they are.
            b.settled = (b.low, b.high) == before and len(v) > 0
        counts = numbers.agg(
            *[F.count_if(x[b.col] < b.low).alias(f"b{k}") for k, b in enumerate(open_)],
            *[F.count_if(b.condition(x[b.col])).alias(f"i{k}") for k, b in enumerate(open_)],
        ).first()
        again = []
        for k, b in enumerate(open_):
            b.below, b.inside = counts[f"b{k}"], counts[f"i{k}"]
            if not b.holds():
                again.append(b)
                b.low, b.high, b.below, b.inside = -math.inf, math.inf, 0, rows[b.col]
            elif b.inside > bracket_rows and b.low < b.high and not b.settled:
                again.append(b)
        open_ = again


def values_at_ranks(df: DataFrame, value: Column, ranks: Sequence[int], bracket_rows: int = BRACKET_ROWS) -> list[float]:
    """The values at some 1-based ranks of a numeric column: as many numbers on the driver as there are ranks."""
    numbers = df.select(value.cast("double").alias("_x0")).filter(F.col("_x0") <= math.inf)
    x = [F.col("_x0")]
    rows = [numbers.count()]
    if not ranks:
        return []
    if min(ranks) < 1 or max(ranks) > rows[0]:
        raise ValueError(f"ranks {ranks} outside of 1..{rows[0]}")
    names = {f"r{i}": rank for i, rank in enumerate(ranks)}
    brackets = [Bracket(0, n, inside=rows[0], at=float(rank - 1)) for n, rank in names.items()]
    _narrow(numbers, x, rows, brackets, bracket_rows)
    found = _pick(numbers, x, ["value"], brackets, names).first()
    return [found[n] for n in names]


def _any(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def _pick(
    numbers: DataFrame, x: Sequence[Column], cols: Sequence[str], brackets: Sequence[Bracket], points: Mapping[str, float]
) -> DataFrame:
    """Interpolate inside the brackets; equal values are counted before they are ranked."""
    spark = numbers.sparkSession
    if not brackets:
        return spark.createDataFrame([], ", ".join(["column string", *[f"{n} double" for n in points]]))
    held = [
        F.when(b.condition(x[b.col]), F.struct(F.lit(k).alias("k"), x[b.col].alias("value"))) for k, b in enumerate(brackets)
    ]
    inside = numbers.filter(_any([b.condition(x[b.col]) for b in brackets])).select(F.explode(F.array(*held)).alias("_h"))
    counts = inside.filter(F.col("_h").isNotNull()).groupBy("_h.k", "_h.value").agg(F.count("*").alias("n"))
    window = Window.partitionBy("k").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(window))

    def table(value) -> Column:
        return F.element_at(F.array(*[F.lit(value(b)) for b in brackets]), F.col("k") + 1)

    first, last = table(lambda b: math.floor(b.at) - b.below), table(lambda b: math.ceil(b.at) - b.below)
    before = F.col("upto") - F.col("n")
    ends = ranked.groupBy("k").agg(
        F.max(F.when((before <= first) & (first < F.col("upto")), F.col("value"))).alias("lo"),
        F.max(F.when((before <= last) & (last < F.col("upto")), F.col("value"))).alias("hi"),
    )
    share = table(lambda b: b.at - math.floor(b.at))
    found = ends.select(
        table(lambda b: cols[b.col]).alias("column"),
        table(lambda b: b.name).alias("name"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value"),
    )
    return found.groupBy("column").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in points])


def long_numbers(df: DataFrame, cols: Sequence[str], keys: Sequence[str], cuts: dict[str, list] | None = None) -> DataFrame:
    """``(keys, column[, part], value)`` of every number; with ``cuts`` also the part of its value."""
    numbers = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    part = lambda i, c: [] if cuts is None else [part_of(F.col(f"_x{i}"), [F.lit(float(v)) for v in cuts.get(c, [])]).alias(PART)]
    structs = [F.struct(F.lit(c).alias("column"), *part(i, c), F.col(f"_x{i}").alias("value")) for i, c in enumerate(cols)]
    long = numbers.select(*keys, F.explode(F.array(*structs)).alias("_v")).select(*keys, "_v.*")
    return long.filter(F.col("value") <= math.inf)


def quantiles_by_parts(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    points: Mapping[str, float] = PERCENTILES,
    rows_per_part: int | None = None,
) -> DataFrame:
    """Exact percentiles per key: count the rows of each part of the value range, sort only the parts that matter.

    A hot key is spread over the parts like the values of the whole table.
    """
    cuts = value_cuts(df, cols, min(MAX_SELECTION_PARTS, max(SELECTION_PARTS, part_count(df.count(), rows_per_part))))
    long = long_numbers(df, cols, keys, cuts)
    group = [*keys, "column"]
    across = Window.partitionBy(*group)
    upto = F.sum("_part_rows").over(across.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = (
        long.groupBy(*group, PART)
        .agg(F.count("*").alias("_part_rows"))
        .withColumns({"_upto": upto, "rows": F.sum("_part_rows").over(across)})
        .withColumn("_before", F.col("_upto") - F.col("_part_rows"))
    )

    def rank(p: float, side) -> Column:
        return side((F.col("rows") - 1) * F.lit(p)).cast("bigint")

    ranks = {f"{n}_{s}": (p, f) for n, p in points.items() for s, f in (("lo", F.floor), ("hi", F.ceil))}
    wanted = _any([(F.col("_before") <= rank(p, f)) & (rank(p, f) < F.col("_upto")) for p, f in ranks.values()])
    chosen = parts.filter(wanted).select(*group, PART, "_before", "rows")
    counts = (
        long.join(chosen.select(*group, PART), [*group, PART], "left_semi")
        .groupBy(*group, PART, "value")
        .agg(F.count("*").alias("n"))
    )
    inside = Window.partitionBy(*group, PART).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.withColumn("_in", F.sum("n").over(inside))
        .join(chosen, [*group, PART])
        .withColumn("upto", F.col("_before") + F.col("_in"))
    )
    before = F.col("upto") - F.col("n")
    picked = ranked.groupBy(*group).agg(
        F.max("rows").alias("_rows"),
        *[
            F.max(F.when((before <= rank(p, f)) & (rank(p, f) < F.col("upto")), F.col("value"))).alias(name)
            for name, (p, f) in ranks.items()
        ],
    )

    def between(name: str, p: float) -> Column:
        at = (F.col("_rows") - 1) * F.lit(p)
        return F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - F.floor(at))

    return picked.select(*group, *[between(n, p).alias(n) for n, p in points.items()])
