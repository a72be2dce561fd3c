"""The whole profile of a table in one call, as a set of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.ordering import part_count, spread
from tabweave.operators import association, cards, dictionary, profile, shifts
from tabweave.roles import Roles, cat_cols, check_roles, cont_cols
from tabweave.session import durable, written


@dataclass(frozen=True)
class TableProfile:
    """Small tables about one big one: at most a few rows per column, pair of columns or category."""

    roles: Roles
    dictionary: DataFrame
    numeric: DataFrame
    shape: DataFrame | None
    modes: DataFrame | None
    edges: DataFrame
    cat_shifts: DataFrame
    cont_shifts: DataFrame


def profile_table(
    df: DataFrame, roles: Roles, order_key: str, shapes: bool = True, symmetric: bool = True, fast: bool = False, dealt: bool = False
) -> TableProfile:
    """Profile complete rows; what later steps read many times is written to the checkpoint folder once.

    The caller chooses the rows: give the training part alone to keep test rows out of the profile. ``fast`` leaves out
    mixture modes and shifts, and takes Pearson correlations over category codes for the associations. ``dealt`` says that ``df``
    comes from ``dealt_once``.
    """
    check_roles(roles)
    cats, conts = cat_cols(roles), cont_cols(roles)
    if not dealt:
        df = dealt_once(df, order_key, list(dict.fromkeys([order_key, *roles])))
    numeric = durable(profile.numeric_profile(df, conts)) if conts else _no_numbers(df)
    labels = durable(dictionary.fit_dictionary(df, cats, order_key)) if cats else _no_labels(df)
    if fast:
        coded = dictionary.encode(df.select(*[F.col(f"`{c}`") for c in roles]), labels, roles) if cats else df
        shape = durable(profile.fit_distribution(df, conts, profile=numeric)) if shapes and conts else None
        return TableProfile(roles, labels, numeric, shape, None, durable(association.coded_edges(coded, roles)), *_no_shifts(df))
    edges = durable(association.association_edges(df, roles, symmetric=symmetric))
    # Cards name the labels that are more likely; label pairs that were never seen are none of them.
    by_cat = shifts.cat_given_cat(df, edges, roles, observed_only=True)
    by_cont = shifts.cat_given_cont(df, edges, roles, profile=numeric, observed_only=True)
    return TableProfile(
        roles,
        labels,
        numeric,
        durable(profile.fit_distribution(df, conts, profile=numeric)) if shapes and conts else None,
        durable(profile.fit_modes(df, conts, profile=numeric)) if shapes and conts else None,
        edges,
        durable(by_cat.unionByName(by_cont)),
        durable(shifts.cont_given_cat(df, edges, roles)),
    )


def dealt_once(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """A large table, which some twenty passes read, spread and written once with its columns ``names``; a small one as it is."""
    rows = df.count()
    if part_count(rows) == 1:
        return df
    return written(spread(df.select(*[F.col(f"`{c}`") for c in names]), rows, [key]))


def _no_numbers(df: DataFrame) -> DataFrame:
    names = ["n", "mean", "std", "min", "max", *profile.PERCENTILES, "skew", "kurtosis"]
    fields = ", ".join(["column string", *[f"{n} {'bigint' if n == 'n' else 'double'}" for n in names]])
    return df.sparkSession.createDataFrame([], fields)


def _no_labels(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, value string, code bigint, n bigint, prob double")


def _no_shifts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    empty = df.sparkSession.createDataFrame
    return (
        empty([], "column string, other string, condition string, value string, shift double"),
        empty([], "column string, other string, label string, mean_shift double, std_shift double"),
    )


# Labels that a card names, of a column and of each sign of a relationship; all of them are in the profile's tables.
MAX_LABELS = 1_000

# The generator variants as combinations of card styles and reply formats.
VARIANTS = {
    "basic": {"categories": "list", "relations": "coefficient", "layout": "csv", "shape": False},
    "basic_bettercat": {"categories": "percent", "relations": "coefficient", "layout": "csv", "shape": False},
    "relationships": {"categories": "percent", "relations": "strength", "layout": "csv", "shape": False},
    "json_relationships": {"categories": "percent", "relations": "relationship", "layout": "json", "shape": False},
    "columnwise_relationships_json_nodist": {
        "categories": "percent", "relations": "relationship", "layout": "columnwise", "shape": False},
    "columnwise_relationships_json": {
        "categories": "percent", "relations": "relationship", "layout": "columnwise", "shape": True},
}


def profile_cards(
    p: TableProfile,
    variant: str = "basic",
    stats: Sequence[str] = cards.DEFAULT_STATS,
    descriptions: dict[str, str] | None = None,
    no_stats: bool = False,
    allowed: DataFrame | None = None,
    max_labels: int | None = MAX_LABELS,
) -> DataFrame:
    """``(column, position, card)`` of every column in the style of a generator variant.

    A card names the ``max_labels`` heaviest labels and counts the others; None names all.
    """
    options = VARIANTS[variant]
    shape, modes = (p.shape, p.modes) if options["shape"] else (None, None)
    numbers = cards.numeric_card(p.numeric, stats, (), shape, modes, no_stats)
    labels = cards.category_card(p.dictionary, "no_stats" if no_stats else options["categories"], top=max_labels)
    relations = None
    if "correlations" in stats and not no_stats:
        edges = p.edges
        if allowed is not None:
            edges = edges.join(F.broadcast(allowed.select("column", "other").distinct()), ["column", "other"], "left_semi")
        if options["relations"] == "coefficient":
            relations = cards.coefficient_card(edges, p.roles)
        else:
            relations = cards.relationship_card(
                edges, p.cat_shifts, p.cont_shifts, p.roles, strength=options["relations"] == "strength", top=max_labels
            )
    return cards.column_card(numbers.unionByName(labels), p.roles, (), relations, descriptions)
