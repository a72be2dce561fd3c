"""Per-column profiles: moments and quantiles, frequencies, distribution shape, mixture modes.

Every operator takes optional ``keys``: the profile is then computed per key, for instance per conversation sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.lookup import long_values, small_side
from tabweave.functions.numeric import norm_cdf, rounded
from tabweave.functions.ordering import PART, ROWS_PER_PART, in_order_parts, part_count, running_total
from tabweave.operators.quantiles import PERCENTILES, as_double, buffered, exact_quantiles, long_numbers
from tabweave.session import durable

# Candidate distributions in the order that decides ties.
CANDIDATES = ("norm", "expon", "uniform")

# Cells of a large column between neighbouring percentiles, and what rounding may take from a distance that bounds others.
FIT_CELLS, FIT_SLACK = 1000, 1e-9

# A mixture is fitted to at most this many weighted bins per column.
BODY_BINS, TAIL_BINS = 3000, 500
# Component limit and the relative BIC gain that a further component must bring.
MAX_MODES, MIN_BIC_GAIN = 10, 0.10


def _moments(c: str) -> list[tuple[str, Column]]:
    x = as_double(c)
    return [
        ("n", F.count(x)),
        ("mean", F.avg(x)),
        ("std", F.stddev_pop(x)),
        ("min", F.min(x)),
        ("max", F.max(x)),
        ("skew", F.skewness(x)),
        ("kurtosis", F.kurtosis(x)),
    ]


def column_moments(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), quantiles: bool = False
) -> DataFrame:
    """``(keys, column, moments...)`` from one aggregation over the table as it is; rows are not multiplied."""
    aggs = {c: _moments(c) for c in cols}
    if quantiles:
        points = F.array(*[F.lit(p) for p in PERCENTILES.values()])
        for c in cols:
            aggs[c].append(("q", F.percentile(as_double(c), points)))
    wide = df.groupBy(*keys).agg(*[a.alias(f"{i}_{name}") for i, c in enumerate(cols) for name, a in aggs[c]])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name, _ in aggs[c]])
            for i, c in enumerate(cols)
        ]
    )
    out = wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    if quantiles:
        out = out.withColumns({p: F.col("q")[i] for i, p in enumerate(PERCENTILES)}).drop("q")
    return out


def ranked_values(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), rows_per_part: int | None = None
) -> DataFrame:
    """``(keys, column, value, n, upto, rows)``: distinct values with their last 1-based rank."""
    counts = long_numbers(df, cols, keys).groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))
    counts, split = in_order_parts(counts, [*keys, "column", "value"], df.count() * len(cols), rows_per_part)
    return running_total(counts, [*keys, "column"], ["value"], "n", "upto", "rows", split).drop(PART)


def numeric_profile(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), rows_per_part: int | None = None
) -> DataFrame:
    """Count, mean, population std, extremes, seven exact percentiles, biased skew and excess kurtosis per column."""
    names = ["n", "mean", "std", "min", "max", *PERCENTILES, "skew", "kurtosis"]
    if buffered(df, keys, rows_per_part):
        return column_moments(df, cols, keys, quantiles=True).select(*keys, "column", *names)
    moments = column_moments(df, cols, keys)
    found = exact_quantiles(df, cols, keys, PERCENTILES, rows_per_part)
    return moments.join(found, [*keys, "column"], "left").select(*keys, "column", *names)


def category_profile(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, column, value, n, prob)``; one shuffle for all columns, after map-side counting."""
    long = df.select(*keys, F.explode(long_values(cols)).alias("_v")).select(*keys, "_v.*")
    counts = long.groupBy(*keys, "column", "value").agg(F.count("*").alias("n"))
    if keys:
        rows = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        shares = counts.join(rows, list(keys))
    else:
        shares = counts.withColumn("_rows", df.agg(F.count("*").alias("rows")).scalar())
    return shares.select(*keys, "column", "value", "n", rounded(F.col("n") / F.col("_rows"), 3).alias("prob"))


def _fitted(value: str, tag: str) -> dict[str, Column]:
    """What the candidates need beside the moments."""
    return {"_varies": F.col("max") > F.col("min"), f"_z{tag}": F.try_divide(F.col(value) - F.col("mean"), F.col("std"))}


def _candidates(value: str, tag: str) -> dict[str, Column]:
    """The candidates' distribution functions at a value; each rises with it."""
    x = F.col(value)
    return {
        "norm": norm_cdf(F.col(f"_z{tag}")),
        "expon": 1 - F.exp(F.try_divide(F.col("min") - x, F.col("mean") - F.col("min"))),
        "uniform": F.try_divide(x - F.col("min"), F.col("max") - F.col("min")),
    }


def _decisive_values(df: DataFrame, cols: Sequence[str], profile: DataFrame, most: int) -> DataFrame | None:
    """The ``ranked_values`` that may decide the distances of a large table's columns; None if a cell holds too many rows.

    Rows are counted in cells between the percentiles. At the ends of a cell the distance is known, and inside it none is
    greater than that from the count before it to the upper end and from the count with it to the lower one. Only cells that
    may reach the greatest known distance of a candidate, the cell it was found in among them, are counted by value.
    """
    points = ["min", *PERCENTILES, "max"]
    x = F.col("value")
    number = F.lit(0)
    for i, (low, high) in enumerate(zip(points, points[1:])):
        width = F.col(high) - F.col(low)
        inner = F.least(F.floor((x - F.col(low)) / width * FIT_CELLS), F.lit(FIT_CELLS - 1))
        place = F.when((width > 0) & (width < math.inf), inner).otherwise(F.lit(0))
        number = F.when(x > F.col(low), i * (FIT_CELLS + 1) + 1 + place).otherwise(number)
    long = long_numbers(df, cols, ()).join(F.broadcast(profile.select("column", *points)), "column").select("column", number.cast("int").alias("cell"), "value")
    cells = long.groupBy("column", "cell").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    order = Window.partitionBy("column").orderBy("cell")
    placed = cells.withColumns({"upto": F.sum("n").over(order), "rows": F.sum("n").over(Window.partitionBy("column"))})
    placed = placed.withColumn("before", F.col("upto") - F.col("n")).join(F.broadcast(profile.select("column", "mean", "std", "min", "max")), "column")
    placed = placed.withColumns({**_fitted("low", "_low"), **_fitted("high", "_high")})
    for side in ("low", "high"):
        placed = placed.withColumns({f"_{side}_{n}": c for n, c in _candidates(side, f"_{side}").items()})
    top, bottom = F.col("upto") / F.col("rows"), F.col("before") / F.col("rows")
    known = {n: F.max(F.greatest(top - F.col(f"_high_{n}"), F.col(f"_low_{n}") - bottom)).over(Window.partitionBy("column")) for n in CANDIDATES}
    placed = placed.withColumns({f"_known_{n}": k for n, k in known.items()})
    reach = [F.greatest(top - F.col(f"_low_{n}"), F.col(f"_high_{n}") - bottom) >= F.col(f"_known_{n}") - FIT_SLACK for n in CANDIDATES]
    decides = (F.col("low") < F.col("high")) & F.coalesce(reduce(Column.__or__, reach), F.lit(True))
    placed = durable(placed.select("column", "cell", "n", "low", "high", "upto", "before", "rows", decides.alias("decides")))
    if (placed.agg(F.max(F.when(F.col("decides"), F.col("n")))).first()[0] or 0) > most:
        return None
    inside = placed.filter("decides").select("column", "cell", "before", "rows")
    counts = long.join(F.broadcast(inside), ["column", "cell"]).groupBy("column", "cell", "before", "rows", "value").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("column", "cell").orderBy("value"))
    found = counts.select("column", "value", "n", upto.alias("upto"), "rows")
    # A cell of one value is counted by value as it is.
    return found.unionByName(placed.filter("low = high").select("column", F.col("low").alias("value"), "n", "upto", "rows"))


def fit_distribution(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_part: int | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Best of normal, exponential and uniform by the Kolmogorov-Smirnov distance of the maximum-likelihood fit.

    For a given row count the test's p value falls as the distance grows, so the smallest distance wins and the earlier
    candidate wins a tie. A constant column has no fit, a column without numbers no row. ``loc`` and ``scale`` are those of the winner.
    ``profile`` is the ``numeric_profile`` if there is one already.
    """
    ranked = None
    if profile is not None and not keys and part_count(df.count() * len(cols), rows_per_part) > 1:
        ranked = _decisive_values(df, cols, profile, rows_per_part or ROWS_PER_PART)
    if ranked is None:
        ranked = ranked_values(df, cols, keys, rows_per_part)
    fit = column_moments(df, cols, keys) if profile is None else profile
    fit = fit.select(*keys, "column", "mean", "std", "min", "max")
    joined = ranked.join(small_side(fit, keys), [*keys, "column"])
    # In steps of named columns: an expression used many times is computed once per value.
    placed = joined.withColumns(
        {"_top": F.col("upto") / F.col("rows"), "_bottom": (F.col("upto") - F.col("n")) / F.col("rows"), **_fitted("value", "")}
    )
    placed = placed.withColumns({f"_{n}": c for n, c in _candidates("value", "").items()})
    gaps = placed.groupBy(*keys, "column", "mean", "std", "min", "max").agg(
        *[
            F.max(
                F.when(F.col("_varies"), F.greatest(F.col("_top") - F.col(f"_{n}"), F.col(f"_{n}") - F.col("_bottom")))
            ).alias(f"ks_{n}")
            for n in CANDIDATES
        ]
    )
    best = F.array_min(
        F.array(
            *[
                F.struct(F.col(f"ks_{n}").alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"))
                for i, n in enumerate(CANDIDATES)
            ]
        )
    )
    picked = gaps.withColumn("_best", F.when(F.col("ks_norm").isNotNull(), best))
    name = F.col("_best.name")
    return picked.select(
        *keys,
        "column",
        name.alias("distribution"),
        F.col("_best.d").alias("ks"),
        F.when(name == "norm", F.col("mean")).when(name.isNotNull(), F.col("min")).alias("loc"),
        F.when(name == "norm", F.col("std"))
        .when(name == "expon", F.col("mean") - F.col("min"))
        .when(name == "uniform", F.col("max") - F.col("min"))
        .alias("scale"),
        *[f"ks_{n}" for n in CANDIDATES],
    )


def _mixture(w: np.ndarray, mean: np.ndarray, square: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """EM for ``k`` normal components on weighted bins; returns the log likelihood and rows of (mean, weight, std)."""
    rows = w.sum()
    share = np.cumsum(w) / rows
    block = np.minimum((share * k - 1e-9).astype(int), k - 1)
    resp = np.zeros((len(w), k))
    resp[np.arange(len(w)), block] = 1.0
    last = -math.inf
    for _ in range(200):
        mass = (resp * w[:, None]).sum(0) + 1e-12
        mu = (resp * (w * mean)[:, None]).sum(0) / mass
        var = (resp * (w * square)[:, None]).sum(0) / mass - mu**2
        var = np.maximum(var, 0) + 1e-6
        inside = square - mean**2
        spread = (mean[:, None] - mu) ** 2 + inside[:, None]
        log_p = np.log(mass / rows) - 0.5 * (np.log(2 * math.pi * var) + spread / var)
        top = log_p.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log_p - top).sum(1))
        likelihood = float((w * total).sum())
        resp = np.exp(log_p - total[:, None])
        if abs(likelihood - last) < 1e-4 * rows:
            break
        last = likelihood
    return likelihood, np.column_stack([mu, mass / rows, np.sqrt(var)])


def choose_modes(bins: pd.DataFrame) -> np.ndarray:
    """Add components while each lowers the BIC by a tenth.

    Bins hold weight ``w``, sum ``sx`` and square sum ``sxx`` of the values less ``shift``.
    """
    bins = bins.sort_values("bin")
    w = bins["w"].to_numpy(float)
    centre = (bins["sx"].sum() / w.sum()) if len(bins) else 0.0
    mean = bins["sx"].to_numpy(float) / w - centre
    square = np.maximum(bins["sxx"].to_numpy(float) / w - 2 * centre * (mean + centre) + centre**2, mean**2)
    best, lowest = None, math.inf
    for k in range(1, min(MAX_MODES, len(w)) + 1):
        likelihood, modes = _mixture(w, mean, square, k)
        bic = -2 * likelihood + (3 * k - 1) * math.log(w.sum())
        if best is not None and (lowest - bic) / abs(lowest) < MIN_BIC_GAIN:
            break
        best, lowest = modes, bic
    best = best[np.argsort(best[:, 0])]
    best[:, 0] += centre + bins["shift"].iloc[0]
    return best


def fit_modes(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_part: int | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """``(keys, column, mode, mean, weight, std)`` of a one-dimensional normal mixture per column.

    Rows are first reduced to a few thousand weighted bins per column (fine between the 1st and 99th percentile, coarse
    outside), with partial sums on the map side; only the bins of a column reach its task. ``profile`` is the
    ``numeric_profile`` if there is one already.
    """
    profile = numeric_profile(df, cols, keys, rows_per_part) if profile is None else profile
    profile = profile.select(*keys, "column", "min", "p01", "p50", "p99", "max")
    long = df.select(*keys, F.explode(long_values(cols, "double")).alias("_v")).select(*keys, "_v.*")
    x, off = F.col("value"), F.col("value") - F.col("p50")

    def cell(low: str, high: str, bins: int) -> Column:
        width = F.col(high) - F.col(low)
        return F.when(width > 0, F.least(F.floor((x - F.col(low)) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))

    number = (
        F.when(x < F.col("p01"), cell("min", "p01", TAIL_BINS))
        .when(x > F.col("p99"), TAIL_BINS + BODY_BINS + cell("p99", "max", TAIL_BINS))
        .otherwise(TAIL_BINS + cell("p01", "p99", BODY_BINS))
    )
    bins = (
        long.filter(x.isNotNull())
        .join(small_side(profile, keys), [*keys, "column"])
        .groupBy(*keys, "column", F.col("p50").alias("shift"), number.cast("int").alias("bin"))
        .agg(F.count("*").alias("w"), F.sum(off).alias("sx"), F.sum(off * off).alias("sxx"))
    )
    group = [*keys, "column"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bins.select(*group).schema.fields)

    def fit(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        modes = choose_modes(pdf)
        out = pd.DataFrame(modes, columns=["mean", "weight", "std"])
        out.insert(0, "mode", range(len(out)))
        for position, (label, value) in enumerate(zip(group, name)):
            out.insert(position, label, value)
        return out

    return bins.groupBy(*group).applyInPandas(fit, f"{kinds}, mode int, mean double, weight double, std double")


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """``(value, n, share, smallest)`` of one column; ``smallest`` is the size of the rarest class."""
    counts = df.groupBy(F.col(f"`{col}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.min("n").alias("smallest"))
    return counts.select(
        "value",
        "n",
        (F.col("n") / totals.select("rows").scalar()).alias("share"),
        totals.select("smallest").scalar().alias("smallest"),
    )
