"""Association between columns: Pearson, Cramér's V, correlation ratio, and the edges kept from them.

All matrices are long: ``(keys, column, other, value)``. Rows are expected to be complete (see ``drop_incomplete``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import long_values, small_side
from tabweave.functions.numeric import rounded
from tabweave.roles import Roles, cat_cols, cont_cols

# Above this many columns one Gramian pass beats one aggregate per pair.
PAIRWISE_COLUMNS = 40
# Fixed value: weaker associations are not edges.
EDGE_THRESHOLD = 0.2


def _finite(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def _mirrored(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of each unordered pair."""
    both = F.array(
        F.struct(F.col("column").alias("column"), F.col("other").alias("other")),
        F.struct(F.col("other").alias("column"), F.col("column").alias("other")),
    )
    return df.select(*keys, F.explode(both).alias("_p"), "value").select(*keys, "_p.*", "value")


def _self_pairs(df: DataFrame, cols: Sequence[str], keys: Sequence[str], value: Column) -> DataFrame:
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("column")
    return base.select(*keys, names).select(*keys, "column", F.col("column").alias("other"), value.alias("value"))


def pearson_matrix(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), diagonal: bool = False
) -> DataFrame:
    """Pearson correlation of every ordered pair; null where a column is constant.

    One aggregation without any row expansion. Wide tables without keys use the Gramian of Spark ML instead. (Spark's
    ``corr`` raises on a constant column, so the quotient is written out.)
    """
    if len(cols) < 2 and not diagonal:
        return df.sparkSession.createDataFrame([], "column string, other string, value double")
    if len(cols) > PAIRWISE_COLUMNS and not keys:
        out = _gramian(df, cols)
        return out if diagonal else out.filter("column <> other")
    pairs = list(combinations(cols, 2)) + ([(c, c) for c in cols] if diagonal else [])
    x = {c: F.col(f"_x{i}") for i, c in enumerate(cols)}
    complete = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]).na.drop(
        subset=[f"_x{i}" for i in range(len(cols))]
    )

    def quotient(a: str, b: str) -> Column:
        return F.try_divide(F.covar_pop(x[a], x[b]), F.stddev_pop(x[a]) * F.stddev_pop(x[b]))

    wide = complete.groupBy(*keys).agg(*[quotient(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"), _finite(F.col(f"c{i}")).alias("value"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    upper = wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    if not diagonal:
        return _mirrored(upper, keys)
    return _mirrored(upper.filter("column <> other"), keys).unionByName(upper.filter("column = other"))


def _gramian(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    safe = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    vectors = VectorAssembler(inputCols=safe.columns, outputCol="v", handleInvalid="skip").transform(safe)
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [
        (a, b, None if matrix[i][j] != matrix[i][j] else float(matrix[i][j]))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, other string, value double")


def contingency(df: DataFrame, cats: Sequence[str], keys: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """``(keys, column, other, value, condition, n)`` of all observed label pairs of all column pairs.

    The rows are expanded by pair inside the scan stage and counted there before the single shuffle.
    """
    pairs = [(a, b) for a in cats for b in cats if a != b] if ordered else list(combinations(cats, 2))
    return _pair_counts(df, pairs, keys)


def _pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    structs = F.array(
        *[
            F.struct(
                F.lit(a).alias("column"),
                F.lit(b).alias("other"),
                F.col(f"`{a}`").cast("string").alias("value"),
                F.col(f"`{b}`").cast("string").alias("condition"),
            )
            for a, b in pairs
        ]
    )
    long = df.select(*keys, F.explode(structs).alias("_p")).select(*keys, "_p.*")
    return long.groupBy(*keys, "column", "other", "value", "condition").agg(F.count("*").alias("n"))


def _with_margin(cells: DataFrame, counted: DataFrame, pair: Sequence[str], label: str, total: str, number: str) -> DataFrame:
    """Add the rows and the number of cells that share a cell's label; a null label is one too."""
    margin = counted.groupBy(*pair, label).agg(F.sum("n").alias(total), F.count("*").alias(number))
    names = {c: f"_m_{c}" for c in [*pair, label]}
    margin = margin.withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(m)) for c, m in names.items()])
    return cells.join(margin, same).drop(*names.values())


def cramers_v_matrix(
    df: DataFrame, cats: Sequence[str], keys: Sequence[str] = (), diagonal: bool = False
) -> DataFrame:
    """Cramér's V of every ordered pair, with Yates' correction on 2x2 tables; null for a one-valued column.

    Cells that never occur need no rows: ``chi2 = n (sum o^2 / (r c) - 1)``, and in a 2x2 table all four cells deviate
    from expectation by the same amount.
    """
    pairs = list(combinations(cats, 2)) + ([(c, c) for c in cats] if diagonal else [])
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, other string, value double")
    # Margins are sums over the counted cells, whose shuffle is reused, so the table is read once. They are joined rather
    # than read over a window: a label that meets very many others is then a skewed join, which Spark splits.
    pair = [*keys, "column", "other"]
    counted = _pair_counts(df, pairs, keys)
    cells = _with_margin(counted, counted, pair, "value", "r", "in_row")
    cells = _with_margin(cells, counted, pair, "condition", "c", "in_col")
    sums = cells.groupBy(*pair).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("fit"),
        F.round(F.sum(1 / F.col("in_row"))).alias("la"),
        F.round(F.sum(1 / F.col("in_col"))).alias("lb"),
        F.sum(1 / (F.col("r") * F.col("in_row"))).alias("ia"),
        F.sum(1 / (F.col("c") * F.col("in_col"))).alias("ib"),
        F.max(F.struct("n", "r", "c")).alias("any"),
    )
    gap = F.abs(F.col("any.n") - F.col("any.r") * F.col("any.c") / F.col("rows"))
    corrected = F.greatest(gap - 0.5, F.lit(0.0))
    chi2 = F.when(
        (F.col("la") == 2) & (F.col("lb") == 2),
        corrected * corrected * F.col("rows") * F.col("ia") * F.col("ib"),
    ).otherwise(F.greatest(F.col("rows") * (F.col("fit") - 1), F.lit(0.0)))
    freedom = F.least("la", "lb") - 1
    v = F.when(freedom > 0, F.sqrt(chi2 / (F.col("rows") * freedom)))
    upper = sums.select(*pair, v.alias("value"))
    off = _mirrored(upper.filter("column <> other"), keys)
    return off.unionByName(upper.filter("column = other")) if diagonal else off


def eta_matrix(
    df: DataFrame, cats: Sequence[str], conts: Sequence[str], keys: Sequence[str] = (), symmetric: bool = True
) -> DataFrame:
    """Correlation ratio of every categorical-continuous pair; null for a constant continuous column.

    Rows are expanded by categorical column only and all continuous columns are averaged side by side.
    ``symmetric=False`` gives the categorical-to-continuous direction alone.
    """
    if not cats or not conts:
        return df.sparkSession.createDataFrame([], "column string, other string, value double")
    numbers = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(conts)]
    long = df.select(*keys, *numbers, F.explode(long_values(cats)).alias("_v"))
    groups = long.groupBy(*keys, F.col("_v.column").alias("column"), F.col("_v.value").alias("label")).agg(
        *[a for i in range(len(conts)) for a in (
            F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.var_pop(f"x{i}").alias(f"v{i}"))],
    )
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("other"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
            for i, c in enumerate(conts)
        ]
    )
    pair = [*keys, "column", "other"]
    means = groups.select(*keys, "column", F.explode(parts).alias("_g")).select(*keys, "column", "_g.*").filter("n > 0")
    # The whole column is the sum of its groups, so the table is read once.
    whole = means.groupBy(*pair).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    gap = F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))
    out = (
        means.join(small_side(whole, keys), pair)
        .groupBy(*pair)
        .agg(F.sum(gap).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
        .withColumn("ss", F.col("between") + F.col("within"))
        .select(*pair, F.when(F.col("ss") > 0, F.sqrt(F.col("between") / F.col("ss"))).alias("value"))
    )
    return _mirrored(out, keys) if symmetric else out


def mixed_matrix(df: DataFrame, roles: Roles, keys: Sequence[str] = (), symmetric: bool = True, diagonal: bool = False):
    """``(keys, column, other, kind, value)`` of the three measures; their column pairs do not overlap."""
    cats, conts = cat_cols(roles), cont_cols(roles)
    parts = []
    if len(conts) > (0 if diagonal else 1):
        parts.append(pearson_matrix(df, conts, keys, diagonal).withColumn("kind", F.lit("pearson")))
    if len(cats) > (0 if diagonal else 1):
        parts.append(cramers_v_matrix(df, cats, keys, diagonal).withColumn("kind", F.lit("cramers_v")))
    if cats and conts:
        parts.append(eta_matrix(df, cats, conts, keys, symmetric).withColumn("kind", F.lit("eta")))
    if not parts:
        empty = df.select(*keys, *[F.lit(None).cast("string").alias(c) for c in ("column", "other", "kind")])
        return empty.withColumn("value", F.lit(None).cast("double")).filter(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*keys, "column", "other", "kind", "value")


def association_edges(
    df: DataFrame,
    roles: Roles,
    threshold: float = EDGE_THRESHOLD,
    keys: Sequence[str] = (),
    symmetric: bool = True,
) -> DataFrame:
    """The associations above ``threshold`` in size, rounded to two places."""
    strong = mixed_matrix(df, roles, keys, symmetric).filter(F.abs("value") > threshold)
    return strong.withColumn("value", rounded(F.col("value"), 2))


def coded_edges(coded: DataFrame, roles: Roles, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """The cheap form of ``association_edges``: Pearson correlations of numbers and category codes alike, in one aggregation.

    ``coded`` holds codes for categories (see ``encode``).
    """
    strong = pearson_matrix(coded, list(roles)).filter(F.abs("value") > threshold)
    return strong.select("column", "other", F.lit("pearson").alias("kind"), rounded(F.col("value"), 2).alias("value"))


def pseudo_r2(df: DataFrame, cat: str, cont: str) -> DataFrame:
    """McFadden's 1 - ll/ll0 of the (multinomial) logistic regression of ``cat`` on ``cont``."""
    data = df.select(F.col(f"`{cat}`").cast("string").alias("c"), F.col(f"`{cont}`").cast("double").alias("x")).na.drop()
    spread = data.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    # The fit is invariant to centring and scaling, and converges better after them.
    scaled = data.withColumn("x", (F.col("x") - F.lit(spread["m"] or 0.0)) / F.lit(spread["s"] or 1.0))
    indexed = StringIndexer(inputCol="c", outputCol="label").fit(scaled).transform(scaled)
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(indexed)
    model = LogisticRegression(regParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(rows)
    p = vector_to_array(F.col("probability"))
    ll = model.transform(rows).agg(F.sum(F.log(F.get(p, F.col("label").cast("int")))).alias("ll"), F.count("*").alias("rows"))
    classes = rows.groupBy("label").agg(F.count("*").alias("n"))
    null = classes.agg((F.sum(F.col("n") * F.log("n")) - F.sum("n") * F.log(F.sum("n"))).alias("ll0"))
    return ll.select(
        F.lit(cat).alias("column"),
        F.lit(cont).alias("other"),
        (1 - F.col("ll") / null.scalar()).alias("value"),
    )
