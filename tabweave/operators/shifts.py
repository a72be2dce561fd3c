"""How one column's distribution shifts under a condition on another, for the associated pairs only.

``edges`` is the result of ``association_edges``: at most the square of the column count per key. Pairs without an
edge are never counted or shuffled. Cells that were never seen are
part of the answer (their shift is minus the base probability), so the result holds every label combination of an edge;
``observed_only`` gives the seen cells alone, where label sets are too large for all combinations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import small_side
from tabweave.functions.numeric import rounded
from tabweave.operators.quantiles import medians
from tabweave.roles import Roles, cat_cols, cont_cols

SHIFT_COLUMNS = ["column", "other", "condition", "value", "shift"]
CONT_SHIFT_COLUMNS = ["column", "other", "label", "mean_shift", "std_shift"]


def _empty(df: DataFrame, keys: Sequence[str], names: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    cols = [F.lit(None).cast("double" if n in numbers else "string").alias(n) for n in names]
    return df.select(*keys, *cols).filter(F.lit(False))


def _pairs(
    df: DataFrame, edges: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], left: str, right: str
) -> DataFrame:
    """``(keys, column, other, a, b)`` of each row and each pair that is an edge.

    Without keys there are at most as many edges as pairs of columns: they are looked up first, and rows are expanded to
    these pairs only.
    """
    if not keys:
        near = {(r["column"], r["other"]) for r in edges.select("column", "other").distinct().collect()}
        pairs = [p for p in pairs if p in near]
        if not pairs:
            names = F.lit(None).cast("string")
            return df.select(
                names.alias("column"), names.alias("other"), F.lit(None).cast(left).alias("a"), F.lit(None).cast(right).alias("b")
            ).filter(F.lit(False))
    structs = [
        F.struct(
            F.lit(a).alias("column"),
            F.lit(b).alias("other"),
            F.col(f"`{a}`").cast(left).alias("a"),
            F.col(f"`{b}`").cast(right).alias("b"),
        )
        for a, b in pairs
    ]
    long = df.select(*keys, F.explode(F.array(*structs)).alias("_p")).select(*keys, "_p.*")
    if not keys:
        return long
    wanted = edges.select(*keys, "column", "other").distinct()
    return long.join(wanted, [*keys, "column", "other"], "left_semi")


def _label_shifts(cells: DataFrame, keys: Sequence[str], observed_only: bool, conditions: DataFrame | None = None) -> DataFrame:
    """P(value | condition) - P(value) from ``(keys, column, other, value, condition, cell)``.

    Every row of the table is in one cell of each pair, so base counts and condition sizes are sums over cells.
    ``conditions`` lists the conditions to report beside the seen ones.
    """
    pair = [*keys, "column", "other"]
    values = cells.groupBy(*pair, "value").agg(F.sum("cell").alias("n"))
    seen = cells.groupBy(*pair, "condition").agg(F.sum("cell").alias("size"))
    rows = seen.groupBy(*pair).agg(F.sum("size").alias("rows"))
    if conditions is not None:
        seen = conditions.join(seen, [*pair, "condition"], "left")
    if observed_only:
        grid = cells.join(seen, [*pair, "condition"]).join(values, [*pair, "value"])
    else:
        grid = seen.join(values, pair).join(cells, [*pair, "condition", "value"], "left")
    inside = F.coalesce(F.col("cell"), F.lit(0)) / F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(1))
    return grid.join(small_side(rows, keys), pair).select(
        *pair, "condition", "value", rounded(inside - F.col("n") / F.col("rows"), 3).alias("shift")
    )


def cat_given_cat(
    df: DataFrame, edges: DataFrame, roles: Roles, keys: Sequence[str] = (), observed_only: bool = False
) -> DataFrame:
    """Shift of each value's probability given each label of the other categorical column."""
    cats = cat_cols(roles)
    pairs = [(a, b) for a in cats for b in cats if a != b]
    if not pairs:
        return _empty(df, keys, SHIFT_COLUMNS, ["shift"])
    cells = (
        _pairs(df, edges, pairs, keys, "string", "string")
        .groupBy(*keys, "column", "other", F.col("a").alias("value"), F.col("b").alias("condition"))
        .agg(F.count("*").alias("cell"))
    )
    return _label_shifts(cells, keys, observed_only)


def cat_given_cont(
    df: DataFrame,
    edges: DataFrame,
    roles: Roles,
    keys: Sequence[str] = (),
    profile: DataFrame | None = None,
    observed_only: bool = False,
) -> DataFrame:
    """Shift of each value's probability where the continuous column is at least (``big``) or below its median."""
    cats, conts = cat_cols(roles), cont_cols(roles)
    pairs = [(a, b) for a in cats for b in conts]
    if not pairs:
        return _empty(df, keys, SHIFT_COLUMNS, ["shift"])
    middle = medians(df, conts, keys) if profile is None else profile
    middle = middle.select(*keys, F.col("column").alias("other"), "p50")
    half = F.when(F.col("b") >= F.col("p50"), "big").otherwise("small")
    cells = (
        _pairs(df, edges, pairs, keys, "string", "double")
        .join(small_side(middle, keys), [*keys, "other"])
        .groupBy(*keys, "column", "other", F.col("a").alias("value"), half.alias("condition"))
        .agg(F.count("*").alias("cell"))
    )
    # An empty half is reported too: its size is taken as one.
    halves = F.explode(F.array(F.lit("big"), F.lit("small"))).alias("condition")
    wanted = edges.filter(F.col("column").isin(cats) & F.col("other").isin(conts)).select(*keys, "column", "other").distinct()
    return _label_shifts(cells, keys, observed_only, wanted.select(*keys, "column", "other", halves))


def cont_given_cat(df: DataFrame, edges: DataFrame, roles: Roles, keys: Sequence[str] = ()) -> DataFrame:
    """Shift of mean and sample standard deviation of a continuous column under each label."""
    cats, conts = cat_cols(roles), cont_cols(roles)
    pairs = [(a, b) for a in conts for b in cats]
    if not pairs:
        return _empty(df, keys, CONT_SHIFT_COLUMNS, ["mean_shift", "std_shift"])
    pair = [*keys, "column", "other"]
    groups = (
        _pairs(df, edges, pairs, keys, "double", "string")
        .groupBy(*pair, F.col("b").alias("label"))
        .agg(F.count("a").alias("n"), F.avg("a").alias("m"), F.stddev_samp("a").alias("s"), F.var_pop("a").alias("v"))
    )
    # Mean and spread of the whole column are pooled from its groups, so the table is read once.
    total = groups.groupBy(*pair).agg(
        F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")
    )
    joined = groups.join(small_side(total, keys), pair)
    gap = F.col("m") - F.col("mean")
    squares = joined.groupBy(*pair).agg(F.sum(F.col("n") * (F.col("v") + gap * gap)).alias("ss"))
    spread = F.sqrt(F.try_divide(F.col("ss"), F.col("rows") - 1))
    return joined.join(small_side(squares, keys), pair).select(
        *pair,
        "label",
        rounded(F.col("m") - F.col("mean"), 2).alias("mean_shift"),
        rounded(F.col("s") - spread, 2).alias("std_shift"),
    )
