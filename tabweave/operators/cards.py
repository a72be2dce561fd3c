"""Text descriptions of columns ("cards"), rendered from profile tables inside Spark.

A card is one text by nature. ``top`` bounds the labels it lists: the heaviest ones are named and the others counted, so that
no list grows with a column's labels. All of them are rows of the dictionary and of the shift tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.numeric import rounded
from tabweave.roles import Roles, cat_cols, cont_cols


# Statistic names accepted in a selection, their profile column and their wording here.
STATS = {
    "min": ("min", "minimum"),
    "max": ("max", "maximum"),
    "mean": ("mean", "mean"),
    "std": ("std", "standard deviation"),
    "25%": ("p25", "first quartile"),
    "50%": ("p50", "median"),
    "75%": ("p75", "third quartile"),
    "skew": ("skew", "skewness"),
    "kurtosis": ("kurtosis", "kurtosis"),
}
# Both spellings select the kurtosis; statistics that describe a shape.
STAT_ALIASES = {"kurtiosis": "kurtosis"}
SHAPE_STATS = {"25%", "50%", "75%", "skew", "kurtosis"}
DEFAULT_STATS = ("min", "max", "mean", "std", "25%", "50%", "75%", "skew", "kurtosis", "correlations")
# Coefficient sizes above which an association is strong or plain.
STRONG, PLAIN = 0.5, 0.3


def selected_stats(stats: Sequence[str]) -> list[str]:
    names = {STAT_ALIASES.get(s, s) for s in stats}
    unknown = names - set(STATS) - {"correlations"}
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    return [s for s in STATS if s in names]


def _number(col: Column) -> Column:
    return F.format_string("%.3f", rounded(col.cast("double"), 3))


def numeric_card(
    profile: DataFrame,
    stats: Sequence[str] = DEFAULT_STATS,
    keys: Sequence[str] = (),
    shape: DataFrame | None = None,
    modes: DataFrame | None = None,
    no_stats: bool = False,
) -> DataFrame:
    """``(keys, column, body)`` with the chosen statistics to three decimals.

    ``shape`` (``fit_distribution``) and ``modes`` (``fit_modes``) add the kind of distribution; a uniform or
    multimodal column is then described by its range alone, since mean and quartiles would mislead.
    """
    group = [*keys, "column"]
    if no_stats:
        text = F.concat(F.lit("Numbers between "), _number(F.col("min")), F.lit(" and "), _number(F.col("max")), F.lit("."))
        return profile.select(*group, text.alias("body"))
    chosen = selected_stats(stats)
    clause = {s: F.concat(F.lit(STATS[s][1] + " "), _number(F.col(STATS[s][0]))) for s in chosen}
    every = F.concat_ws(", ", *clause.values())
    if shape is None:
        opening, details = F.lit("Numbers"), every
    else:
        out = profile.join(shape.select(*group, "distribution"), group, "left")
        if modes is not None:
            part = F.concat(_number(F.col("mean")), F.lit(" (weight "), _number(F.col("weight")), F.lit(")"))
            many = modes.groupBy(*group).agg(
                F.count("*").alias("_modes"), F.array_sort(F.collect_list(F.struct("mode", part.alias("t")))).alias("_list")
            )
            out = out.join(many, group, "left")
        else:
            out = out.withColumns({"_modes": F.lit(1), "_list": F.lit(None)})
        profile = out
        multimodal = F.coalesce(F.col("_modes") > 1, F.lit(False))
        kind = F.col("distribution")
        plain = not SHAPE_STATS & set(chosen)
        opening = F.lit("Numbers") if plain else (
            F.when(
                multimodal,
                F.concat(
                    F.lit("Numbers from a mixture of "),
                    F.col("_modes").cast("string"),
                    F.lit(" modes at "),
                    F.array_join(F.transform("_list", lambda m: m["t"]), ", ") if modes is not None else F.lit(""),
                ),
            )
            .when(kind == "norm", F.lit("Normally distributed numbers"))
            .when(kind == "uniform", F.lit("Evenly distributed numbers"))
            .when(kind == "expon", F.lit("Exponentially distributed numbers"))
            .otherwise(F.lit("Numbers"))
        )
        limits = F.concat_ws(", ", *[clause[s] for s in chosen if s in ("min", "max")])
        details = F.when(multimodal | F.coalesce(kind == "uniform", F.lit(False)), limits).otherwise(every)
    text = F.when(details == "", F.concat(opening, F.lit("."))).otherwise(
        F.concat(opening, F.lit(" with "), details, F.lit("."))
    )
    return profile.select(*group, text.alias("body"))


def category_card(
    dictionary: DataFrame, style: str = "percent", keys: Sequence[str] = (), order: str = "code", max_values: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """``(keys, column, body)`` from ``(keys, column, value, prob, <order>)``.

    A card is one text with every value, so a task has to hold it. ``max_values`` makes more values an error; ``top`` lists the
    likeliest ones, in the same order as ever, and counts the others.

    Styles: ``list`` (values and probabilities in two lists), ``percent`` (a line per value) and ``no_stats`` (values).
    """
    group = [*keys, "column"]
    percent = F.bround(F.col("prob") * 100)
    share = F.when(percent == 0, F.lit("in fewer than 1 of 100 rows")).otherwise(
        F.concat(F.lit("in "), percent.cast("int").cast("string"), F.lit(" of 100 rows"))
    )
    line = F.concat(F.lit("- "), F.col("value"))
    item = F.concat(line, F.lit(": "), share) if style == "percent" else line
    if max_values is not None:
        sizes = dictionary.groupBy(*group).agg(F.count("*").alias("_entries"))
        dictionary = dictionary.join(sizes, group).withColumn(
            "value",
            F.when(F.col("_entries") <= max_values, F.col("value")).otherwise(
                F.raise_error(F.concat(F.lit("too many categories for a card: "), F.col("column")))
            ),
        )
    if top is not None:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("prob").desc(), order))
        sizes = dictionary.groupBy(*group).agg(F.count("*").alias("_all"))
        dictionary = dictionary.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place").join(sizes, group)
    others = F.first("_all") - F.count("*") if top is not None else F.lit(0)
    rows = dictionary.groupBy(*group).agg(
        others.alias("_others"),
        F.array_sort(
            F.collect_list(
                F.struct(F.col(order).alias("o"), "value", item.alias("item"), F.col("prob").cast("string").alias("p"))
            )
        ).alias("_rows")
    )
    join = lambda field, sep: F.array_join(F.transform("_rows", lambda r: r[field]), sep)
    if style == "list":
        body = F.concat(F.lit("One of ["), join("value", ", "), F.lit("] with probabilities ["), join("p", ", "), F.lit("]."))
    elif style in ("percent", "no_stats"):
        heading = "Categories and how often they occur:\n" if style == "percent" else "Categories:\n"
        body = F.concat(F.lit(heading), join("item", "\n"))
    else:
        raise ValueError(f"unknown style {style!r}")
    more = F.when(F.col("_others") > 0, F.concat(F.lit("\nand "), F.col("_others").cast("string"), F.lit(" rarer values"))).otherwise(F.lit(""))
    return rows.select(*group, F.concat(body, more).alias("body"))


def _link(value: Column) -> Column:
    """How strong a link is, in words."""
    size = F.abs(value)
    return F.when(size > STRONG, F.lit("a strong link")).when(size > PLAIN, F.lit("a clear link")).otherwise(F.lit("a faint link"))


def _pearson_sentence(value: Column) -> Column:
    way = F.when(value > 0, F.lit(", rising together")).otherwise(F.lit(", moving against each other"))
    return F.concat(
        F.col("column"), F.lit(" and "), F.col("other"), F.lit(": "), _link(value), way,
        F.lit(" (Pearson "), F.format_string("%.2f", value), F.lit(")."),
    )


def _in_order(sentences: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("other"))
    return sentences.groupBy(*keys, "column").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "sentence"))), lambda s: s["sentence"]), "\n"
        ).alias("body")
    )


def coefficient_card(edges: DataFrame, roles: Roles, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, column, body)``: one sentence per edge with strength, measure and coefficient."""
    value = F.col("value")
    # The name of each measure.
    measure = F.when(F.col("kind") == "cramers_v", F.lit("Cramér's V")).otherwise(F.lit("correlation ratio"))
    other = F.concat(
        F.col("column"), F.lit(" and "), F.col("other"), F.lit(": "), _link(value),
        F.lit(" ("), measure, F.lit(" "), F.format_string("%.2f", value), F.lit(")."),
    )
    sentence = F.when(F.col("kind") == "pearson", _pearson_sentence(value)).otherwise(other)
    return _in_order(edges.withColumn("sentence", sentence), keys, list(roles))


def _heaviest(shifts: DataFrame, group: Sequence[str], label: str, shift: str, top: int | None) -> DataFrame:
    """``(group, up, labels)``: the labels that go up (or not) as one text, the ``top`` largest shifts and how many more."""
    signed = shifts.withColumn("_up", F.col(shift) >= 0)
    by = [*group, "_up"]
    if top is not None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(shift).desc(), label))
        sizes = signed.groupBy(*by).agg(F.count("*").alias("_all"))
        signed = signed.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place").join(sizes, by)
    listed = F.array_join(F.array_sort(F.collect_list(label)), ", ")
    others = F.first("_all") - F.count("*") if top is not None else F.lit(0)
    texts = signed.groupBy(*by).agg(listed.alias("_labels"), others.alias("_others"))
    more = F.when(F.col("_others") > 0, F.concat(F.lit(" and "), F.col("_others").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return texts.select(*group, "_up", F.concat("_labels", more).alias("_labels"))


def _side(up: bool) -> Column:
    """The labels of one sign, empty if there are none."""
    return F.coalesce(F.max(F.when(F.col("_up") == up, F.col("_labels"))), F.lit(""))


def relationship_card(
    edges: DataFrame,
    cat_shifts: DataFrame,
    cont_shifts: DataFrame,
    roles: Roles,
    keys: Sequence[str] = (),
    strength: bool = False,
    allowed: DataFrame | None = None,
    top: int | None = None,
) -> DataFrame:
    """``(keys, column, body)``: per edge, which labels go with more or less of the column.

    ``cat_shifts`` unites ``cat_given_cat`` and ``cat_given_cont``; ``cont_shifts`` is ``cont_given_cat``. ``allowed``
    restricts to some ``(keys, column, other)``, such as columns that were generated before. ``top`` lists that many labels
    of each sign, those that shift most, and as many conditions, those whose labels shift most; the others are counted.
    """
    pair = [*keys, "column", "other"]
    if allowed is not None:
        edges = edges.join(allowed.select(*pair).distinct(), pair, "left_semi")
    cats, conts = cat_cols(roles), cont_cols(roles)
    if top is not None:
        # A condition is a label of the other column: of those too the ones that matter most are named.
        weights = cat_shifts.groupBy(*pair, "condition").agg(F.max(F.abs("shift")).alias("_weight"))
        place = F.row_number().over(Window.partitionBy(*pair).orderBy(F.col("_weight").desc(), "condition"))
        named = weights.withColumn("_place", place).filter(F.col("_place") <= top).select(*pair, "condition")
        more = weights.groupBy(*pair).agg(F.greatest(F.count("*") - top, F.lit(0)).alias("_more"))
        cat_shifts = cat_shifts.join(named, [*pair, "condition"], "left_semi")
    by_condition = _heaviest(cat_shifts, [*pair, "condition"], "value", "shift", top).groupBy(*pair, "condition").agg(_side(True).alias("likely"))
    is_number = F.col("other").isin(conts)
    side = F.when(F.col("condition") == "big", F.lit("above")).otherwise(F.lit("below"))
    clause = F.when(is_number, F.concat(F.lit("when "), F.col("other"), F.lit(" is "), side, F.lit(" its median"))).otherwise(
        F.concat(F.lit("when "), F.col("other"), F.lit(" is "), F.col("condition"))
    )
    cat_text = by_condition.withColumn("_t", F.concat(clause, F.lit(", more often "), F.col("likely"))).groupBy(*pair).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("condition", "_t"))), lambda s: s["_t"]), "; ").alias("_cat")
    )
    if top is not None:
        rest = F.when(F.col("_more") > 0, F.concat(F.lit("; and "), F.col("_more").cast("string"), F.lit(" more cases"))).otherwise(F.lit(""))
        cat_text = cat_text.join(more, pair).select(*pair, F.concat("_cat", rest).alias("_cat"))
    cont_text = _heaviest(cont_shifts, pair, "label", "mean_shift", top).groupBy(*pair).agg(
        F.concat(F.lit("higher for "), _side(True), F.lit("; lower for "), _side(False)).alias("_cont")
    )
    joined = edges.join(cat_text, pair, "left").join(cont_text, pair, "left")
    words = F.concat(F.lit(", "), _link(F.col("value"))) if strength else F.lit("")
    detail = F.when(F.col("column").isin(cats), F.col("_cat")).otherwise(F.col("_cont"))
    influenced = F.concat(F.col("column"), F.lit(" depends on "), F.col("other"), words, F.lit(": "), F.coalesce(detail, F.lit("")), F.lit("."))
    sentence = F.when(F.col("kind") == "pearson", _pearson_sentence(F.col("value"))).otherwise(influenced)
    return _in_order(joined.withColumn("sentence", sentence), keys, list(roles))


def column_card(
    bodies: DataFrame,
    roles: Roles,
    keys: Sequence[str] = (),
    associations: DataFrame | None = None,
    descriptions: dict[str, str] | None = None,
) -> DataFrame:
    """``(keys, column, position, card)``: header, type, optional description, body and association sentences."""
    group = [*keys, "column"]
    names = F.array(*[F.lit(c) for c in roles])
    types = F.create_map(*[F.lit(x) for c, r in roles.items() for x in (c, r)])
    lines = [F.concat(F.lit("# Column: "), F.col("column")), F.concat(F.lit("Type: "), F.try_element_at(types, F.col("column")))]
    if descriptions:
        texts = F.create_map(*[F.lit(x) for c, d in descriptions.items() for x in (c, d)])
        lines.append(F.try_element_at(texts, F.col("column")))
    lines.append(F.col("body"))
    out = bodies
    if associations is not None:
        out = out.join(associations.withColumnRenamed("body", "_assoc"), group, "left")
        lines.append(F.col("_assoc"))
    # concat_ws leaves out the lines that are null.
    return out.select(
        *group, F.array_position(names, F.col("column")).cast("int").alias("position"), F.concat_ws("\n", *lines).alias("card")
    )
