"""How close synthetic columns are to real ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.lookup import one_row
from tabweave.functions.ordering import PART, global_rank, in_order_parts, running_totals
from tabweave.operators.association import mixed_matrix, pearson_matrix
from tabweave.operators.profile import column_moments
from tabweave.roles import Roles


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, mean, std)`` with the population standard deviation; a constant column scales by one."""
    moments = column_moments(df, cols)
    return moments.select("column", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("std"))


def standard_scale(df: DataFrame, fit_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores of ``cols`` under the moments of ``fit_df``."""
    return apply_scaler(df, fit_scaler(fit_df, cols), cols)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    fit = one_row(
        scaler.agg(
            *[F.max(F.when(F.col("column") == c, F.col("mean"))).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.max(F.when(F.col("column") == c, F.col("std"))).alias(f"s{i}") for i, c in enumerate(cols)],
        )
    )
    return df.withColumns({c: (F.col(f"`{c}`") - fit[f"m{i}"]) / fit[f"s{i}"] for i, c in enumerate(cols)})


def _matrix_gap(real: DataFrame, synthetic: DataFrame, name: str) -> DataFrame:
    a = real.withColumnRenamed("value", "_a")
    b = synthetic.withColumnRenamed("value", "_b")
    return a.join(b, ["column", "other"]).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias(name))


def correlation_gap(real: DataFrame, synthetic: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute difference of the full Pearson matrices, diagonal included; null if any entry is undefined.

    With ``keys`` of the synthetic rows one matrix of theirs per key.
    """
    a, b = pearson_matrix(real, cols, diagonal=True), pearson_matrix(synthetic, cols, keys, diagonal=True)
    pairs = b.withColumnRenamed("value", "_b").join(F.broadcast(a.withColumnRenamed("value", "_a")), ["column", "other"])
    gap = F.abs(F.col("_a") - F.col("_b"))
    return pairs.groupBy(*keys).agg(F.when(F.count(gap) == F.count("*"), F.avg(gap)).alias("score"))


def mixed_correlation_gap(real: DataFrame, synthetic: DataFrame, roles: Roles) -> DataFrame:
    """The same over Pearson, Cramér's V and correlation ratio together; undefined entries count as zero."""
    a = mixed_matrix(real, roles, diagonal=True).drop("kind").withColumn("value", F.coalesce("value", F.lit(0.0)))
    b = mixed_matrix(synthetic, roles, diagonal=True).drop("kind").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return _matrix_gap(a, b, "score")


def target_correlation_gap(real: DataFrame, synthetic: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Mean absolute difference of the target's Pearson correlations with the other columns."""
    row = (F.col("column") == target) & (F.col("other") != target)
    return _matrix_gap(pearson_matrix(real, cols).filter(row), pearson_matrix(synthetic, cols).filter(row), "score")


def _heads(
    real: DataFrame, synthetic: DataFrame, order: Sequence[str], rows_per_part: int | None
) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the length of the shorter, in the given order, with their 1-based ``_rank``."""
    a = global_rank(real, order, "_rank", "_rows", rows_per_part)
    b = global_rank(synthetic, order, "_rank", "_rows", rows_per_part)
    rows = real.agg(F.count("*").alias("n")).scalar(), synthetic.agg(F.count("*").alias("n")).scalar()
    shorter = F.least(*rows)
    return a.filter(F.col("_rank") <= shorter).drop("_rows"), b.filter(F.col("_rank") <= shorter).drop("_rows")


def jensen_shannon(
    real: DataFrame, synthetic: DataFrame, cols: Sequence[str], order: Sequence[str], rows_per_part: int | None = None
) -> DataFrame:
    """Jensen-Shannon distance of integer columns read as weight vectors in row order, averaged over the columns.

    Both sides are cut to equal length and joined on position. A negative weight or a zero sum has no distance.
    """
    a, b = _heads(real, synthetic, order, rows_per_part)
    whole = lambda c: F.col(f"`{c}`").cast("bigint")
    left = a.select("_rank", *[whole(c).alias(f"p{i}") for i, c in enumerate(cols)])
    right = b.select("_rank", *[whole(c).alias(f"q{i}") for i, c in enumerate(cols)])
    sums = left.agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(cols))])
    other = right.agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(len(cols))])
    p_all, q_all = one_row(sums), one_row(other)

    def term(x: Column, m: Column) -> Column:
        return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(F.try_divide(x, m)))

    # Shares are columns of their own: an aggregate may not contain a subquery.
    joined = left.join(right, "_rank").select(
        *[F.try_divide(F.col(f"p{i}"), p_all[f"p{i}"]).alias(f"p{i}") for i in range(len(cols))],
        *[F.try_divide(F.col(f"q{i}"), q_all[f"q{i}"]).alias(f"q{i}") for i in range(len(cols))],
    )

    def divergence(i: int) -> Column:
        p, q = F.col(f"p{i}"), F.col(f"q{i}")
        m = (p + q) / 2
        total = F.sum(term(p, m) + term(q, m)) / 2
        valid = (F.min(p) >= 0) & (F.min(q) >= 0)
        return F.when(valid, F.sqrt(F.greatest(total, F.lit(0.0)))).otherwise(F.lit(float("nan")))

    return joined.agg((sum((divergence(i) for i in range(1, len(cols))), divergence(0)) / len(cols)).alias("score"))


def wasserstein(
    real: DataFrame,
    synthetic: DataFrame,
    cols: Sequence[str],
    order: Sequence[str] | None = None,
    scaler: DataFrame | None = None,
    rows_per_part: int | None = None,
) -> DataFrame:
    """``(column, distance)``: one-dimensional earth mover's distance of each column.

    With an ``order`` both sides are cut to the length of the shorter first. Values are counted before anything is
    sorted; one scan in order sums up both sides, and the last value of a part is carried over its edge.
    """
    most = (real.select().unionAll(synthetic.select()).count()) * len(cols)
    if order is not None:
        real, synthetic = _heads(real, synthetic, order, rows_per_part)
    if scaler is not None:
        real, synthetic = apply_scaler(real, scaler, cols), apply_scaler(synthetic, scaler, cols)
    double = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    both = real.select(*double, F.lit(1).alias("_u"), F.lit(0).alias("_v")).unionAll(
        synthetic.select(*double, F.lit(0).alias("_u"), F.lit(1).alias("_v"))
    )
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols]
    long = both.select("_u", "_v", F.explode(F.array(*structs)).alias("_s")).select("_u", "_v", "_s.*")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("_u").alias("u"), F.sum("_v").alias("v"))
    counts, split = in_order_parts(counts, ["column", "value"], most, rows_per_part)
    scanned = running_totals(counts, ["column"], ["value"], {"cu": "u", "cv": "v"}, {"cu": "nu", "cv": "nv"}, split, last=("value", "_edge"))
    earlier = F.lag("value").over(Window.partitionBy("column", *([PART] if split else [])).orderBy("value"))
    # What has been summed up before a value holds from the value before it on.
    shares = [F.try_divide(F.col(c) - F.col(a), F.col(n)) for c, a, n in (("cu", "u", "nu"), ("cv", "v", "nv"))]
    gap = F.abs(shares[0] - shares[1]) * (F.col("value") - F.coalesce(earlier, F.col("_edge")))
    # One distinct value has no gaps and distance zero; an empty side has no distance.
    filled = (F.min("nu") > 0) & (F.min("nv") > 0)
    distance = F.when(filled, F.coalesce(F.sum("_gap"), F.lit(0.0)))
    return scanned.withColumn("_gap", gap).groupBy("column").agg(distance.alias("distance"))


def mean_wasserstein(real: DataFrame, synthetic: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    """The mean of ``wasserstein`` over the columns."""
    return wasserstein(real, synthetic, cols, **options).agg(F.avg("distance").alias("score"))
