from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import cards, profile, shifts
from tabweave.plans.profiling import profile_cards, profile_table
from workload.associations import CAT_CAT_SQL, CAT_CONT_SQL, CONT_CAT_SQL, EDGES_SQL, SHIFT_TABLES, sales_edges
from workload.common import (
    LINEITEM_CONTS, SALES_CATS, SALES_ROLES, SALES_SQL, query, r, sales, table, unpivot_sql,
)
from workload.encoding import DICTIONARY_SQL, fitted


def _f3(expr: str) -> str:
    return f"printf('%.3f', {r(expr, 3)})"


_STATS_SQL = {
    "minimum": "min(value)",
    "maximum": "max(value)",
    "mean": "avg(value)",
    "standard deviation": "stddev_pop(value)",
    "first quartile": "quantile_cont(value, 0.25)",
    "median": "quantile_cont(value, 0.5)",
    "third quartile": "quantile_cont(value, 0.75)",
    "skewness": "avg((value - m) ** 3) / stddev_pop(value) ** 3",
    "kurtosis": "kurtosis_pop(value)",
}
_SENTENCE = " || ', ' || ".join(f"'{name} ' || {_f3(e)}" for name, e in _STATS_SQL.items())
_LONG = f"""WITH long AS (SELECT *, avg(value) OVER (PARTITION BY "column") AS m FROM ({unpivot_sql(LINEITEM_CONTS, 'lineitem', 'DOUBLE')}))"""
NUMERIC_CARD_SQL = f"""{_LONG} SELECT "column", 'Numbers with ' || {_SENTENCE} || '.' AS body FROM long GROUP BY "column" """


@query(NUMERIC_CARD_SQL)
def numeric_card(spark, sf):
    return cards.numeric_card(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS), [*cards.STATS, "correlations"])


@query(
    f"""{_LONG} SELECT "column", 'Numbers with minimum ' || {_f3('min(value)')} || ', kurtosis ' || {_f3('kurtosis_pop(value)')} || '.' AS body
    FROM long GROUP BY "column" """
)
def numeric_card_chosen_stats(spark, sf):
    """The other spelling of kurtosis selects it too."""
    return cards.numeric_card(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS), ["min", "kurtiosis"])


@query(
    f"""{_LONG} SELECT "column", 'Numbers between ' || {_f3('min(value)')} || ' and ' || {_f3('max(value)')} || '.' AS body
    FROM long GROUP BY "column" """
)
def numeric_card_range_only(spark, sf):
    return cards.numeric_card(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS), no_stats=True)


@query(
    f"""{_LONG} SELECT "column", 'Evenly distributed numbers with minimum ' || {_f3('min(value)')} || ', maximum ' || {_f3('max(value)')} || '.' AS body
    FROM long GROUP BY "column" """
)
def numeric_card_uniform(spark, sf):
    """All four columns fit a uniform best, which leaves their range."""
    lines = table(spark, sf, "lineitem")
    shape = profile.fit_distribution(lines, LINEITEM_CONTS)
    return cards.numeric_card(profile.numeric_profile(lines, LINEITEM_CONTS), shape=shape)


@query()
def numeric_card_with_modes(spark, sf):
    lines = table(spark, sf, "lineitem")
    shape, modes = profile.fit_distribution(lines, LINEITEM_CONTS), profile.fit_modes(lines, LINEITEM_CONTS)
    return cards.numeric_card(profile.numeric_profile(lines, LINEITEM_CONTS), shape=shape, modes=modes)


_LINES = """string_agg('- ' || value || {share}, chr(10) ORDER BY code, value)"""
_SHARE = """': ' || CASE WHEN round_even(prob * 100, 0) = 0 THEN 'in fewer than 1 of 100 rows'
  ELSE 'in ' || CAST(CAST(round_even(prob * 100, 0) AS INTEGER) AS VARCHAR) || ' of 100 rows' END"""


@query(
    f"""WITH {DICTIONARY_SQL}
    SELECT "column", 'Categories and how often they occur:' || chr(10) || {_LINES.format(share=_SHARE)} AS body FROM dict GROUP BY "column" """
)
def category_card_percent(spark, sf):
    return cards.category_card(fitted(spark, sf), "percent")


@query(
    f"""WITH {DICTIONARY_SQL}
    SELECT "column", 'One of [' || string_agg(value, ', ' ORDER BY code) || '] with probabilities ['
      || string_agg(CAST(prob AS VARCHAR), ', ' ORDER BY code) || '].' AS body FROM dict GROUP BY "column" """
)
def category_card_list(spark, sf):
    return cards.category_card(fitted(spark, sf), "list")


@query(
    f"""WITH {DICTIONARY_SQL}
    SELECT "column", 'Categories:' || chr(10) || string_agg('- ' || value, chr(10) ORDER BY code) AS body FROM dict GROUP BY "column" """
)
def category_card_values_only(spark, sf):
    return cards.category_card(fitted(spark, sf), "no_stats")


_PLACE = "list_position([" + ", ".join(f"'{c}'" for c in SALES_ROLES) + "], other)"
_LINK = "CASE WHEN abs(value) > 0.5 THEN 'a strong link' WHEN abs(value) > 0.3 THEN 'a clear link' ELSE 'a faint link' END"
_PEARSON = f""""column" || ' and ' || other || ': ' || {_LINK} || CASE WHEN value > 0 THEN ', rising together' ELSE ', moving against each other' END
  || ' (Pearson ' || printf('%.2f', value) || ').'"""
_COEFFICIENT = f"""CASE WHEN kind = 'pearson' THEN {_PEARSON}
  ELSE "column" || ' and ' || other || ': ' || {_LINK} || ' ('
    || CASE WHEN kind = 'cramers_v' THEN 'Cramér''s V' ELSE 'correlation ratio' END || ' ' || printf('%.2f', value) || ').' END"""


@query(
    f"""WITH {SALES_SQL}, {EDGES_SQL}
    SELECT "column", string_agg({_COEFFICIENT}, chr(10) ORDER BY {_PLACE}) AS body FROM edges GROUP BY "column" """
)
def coefficient_card(spark, sf):
    return cards.coefficient_card(sales_edges(spark, sf), SALES_ROLES)


def _relationship_sql(strength: bool, allowed: str = "TRUE") -> str:
    words = f"', ' || {_LINK}" if strength else "''"
    names = "(" + ", ".join(f"'{c}'" for c in SALES_CATS) + ")"
    return f"""WITH {SALES_SQL}, {EDGES_SQL}, {SHIFT_TABLES}, {CAT_CAT_SQL}, {CAT_CONT_SQL}, {CONT_CAT_SQL},
    cat_shift AS (SELECT *, 'when ' || other || ' is ' || condition AS clause FROM cat_cat
      UNION ALL SELECT *, 'when ' || other || ' is ' || CASE condition WHEN 'big' THEN 'above' ELSE 'below' END || ' its median' FROM cat_cont),
    by_condition AS (SELECT "column", other, condition, clause, string_agg(value, ', ' ORDER BY value) FILTER (shift >= 0) AS likely
      FROM cat_shift GROUP BY ALL),
    cat_text AS (SELECT "column", other, string_agg(clause || ', more often ' || coalesce(likely, ''), '; ' ORDER BY condition) AS t
      FROM by_condition GROUP BY ALL),
    cont_text AS (SELECT "column", other, 'higher for ' || coalesce(string_agg(label, ', ' ORDER BY label) FILTER (mean_shift >= 0), '')
      || '; lower for ' || coalesce(string_agg(label, ', ' ORDER BY label) FILTER (mean_shift < 0), '') AS t FROM cont_cat GROUP BY ALL),
    sentences AS (SELECT "column", other, CASE WHEN kind = 'pearson' THEN {_PEARSON}
        ELSE "column" || ' depends on ' || other || {words} || ': '
          || CASE WHEN "column" IN {names} THEN coalesce(c.t, '') ELSE coalesce(n.t, '') END || '.' END AS s
      FROM edges LEFT JOIN cat_text c USING ("column", other) LEFT JOIN cont_text n USING ("column", other) WHERE {allowed})
    SELECT "column", string_agg(s, chr(10) ORDER BY {_PLACE}) AS body FROM sentences GROUP BY "column" """


def _relationships(spark, sf, **options):
    data, edges = sales(spark, sf), sales_edges(spark, sf)
    by_cat = shifts.cat_given_cat(data, edges, SALES_ROLES).unionByName(shifts.cat_given_cont(data, edges, SALES_ROLES))
    by_label = shifts.cont_given_cat(data, edges, SALES_ROLES)
    return cards.relationship_card(edges, by_cat, by_label, SALES_ROLES, **options)


@query(_relationship_sql(False))
def relationship_card(spark, sf):
    return _relationships(spark, sf)


@query(_relationship_sql(True))
def relationship_card_strength(spark, sf):
    return _relationships(spark, sf, strength=True)


@query(_relationship_sql(False, "other IN ('price', 'half')"))
def relationship_card_earlier_columns(spark, sf):
    allowed = sales_edges(spark, sf).filter(F.col("other").isin("price", "half")).select("column", "other")
    return _relationships(spark, sf, allowed=allowed)


@query(
    NUMERIC_CARD_SQL.replace(
        'SELECT "column", ',
        """SELECT "column", list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], "column") AS position,
          '# Column: ' || "column" || chr(10) || 'Type: float' || chr(10)
          || CASE "column" WHEN 'l_tax' THEN 'Tax rate' || chr(10) ELSE '' END || """,
        1,
    ).replace("AS body", "AS card")
)
def column_card(spark, sf):
    body = cards.numeric_card(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS))
    roles = {c: "float" for c in LINEITEM_CONTS}
    return cards.column_card(body, roles, descriptions={"l_tax": "Tax rate"})


@query()
def profile_cards_all_variants(spark, sf):
    from tabweave.plans.profiling import VARIANTS

    p = profile_table(sales(spark, sf), SALES_ROLES, "id")
    sheets = [profile_cards(p, v).withColumn("variant", F.lit(v)) for v in VARIANTS]
    out = sheets[0]
    for sheet in sheets[1:]:
        out = out.unionByName(sheet)
    return out
