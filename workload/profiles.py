from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.functions.numeric import NORM_TAIL_DENOMINATOR, NORM_TAIL_NUMERATOR
from tabweave.functions.seeded import standard_normal
from tabweave.operators import profile
from workload.common import LINEITEM_CATS, LINEITEM_CONTS, normal_sql, query, r, table, trimmed, unpivot_sql

POINTS = profile.PERCENTILES


# Seven places: the mean of a column of cents can lie exactly between two numbers of six.
PLACES = 7


def _moments_sql(keys: str = "") -> str:
    """Moments and percentiles of ``long(keys, column, value)``; DuckDB's skewness is bias-corrected, so it is spelled out."""
    quantiles = ", ".join(f"{r(f'quantile_cont(value, {p})', PLACES)} AS {n}" for n, p in POINTS.items())
    return f"""SELECT {keys} "column", count(value) AS n, {r('avg(value)', PLACES)} AS mean, {r('stddev_pop(value)', PLACES)} AS std,
      {r('min(value)', PLACES)} AS min, {r('max(value)', PLACES)} AS max, {quantiles},
      {r('avg((value - m) ** 3) / stddev_pop(value) ** 3', PLACES)} AS skew, {r('kurtosis_pop(value)', PLACES)} AS kurtosis
    FROM (SELECT *, avg(value) OVER (PARTITION BY {keys} "column") AS m FROM long) GROUP BY {keys} "column" """


ROUNDED = ["mean", "std", "min", "max", *POINTS, "skew", "kurtosis"]


@query(f"WITH long AS ({unpivot_sql(LINEITEM_CONTS, 'lineitem', 'DOUBLE')}) {_moments_sql()}")
def numeric_profile(spark, sf):
    return trimmed(profile.numeric_profile(table(spark, sf, "lineitem"), LINEITEM_CONTS), PLACES, *ROUNDED)


@query(f"WITH long AS ({unpivot_sql(LINEITEM_CONTS, 'lineitem', 'DOUBLE')}) {_moments_sql()}")
def numeric_profile_by_brackets(spark, sf):
    """The path of large tables: percentiles out of brackets."""
    lines = table(spark, sf, "lineitem")
    parts = profile.numeric_profile(lines, LINEITEM_CONTS, rows_per_part=max(1, lines.count() // 6))
    return trimmed(parts, PLACES, *ROUNDED)


@query(f"""WITH long AS ({unpivot_sql(['value'], 'events', 'DOUBLE', 'event_type,')}) {_moments_sql('event_type,')}""")
def numeric_profile_per_key(spark, sf):
    return trimmed(profile.numeric_profile(table(spark, sf, "events"), ["value"], ["event_type"]), PLACES, *ROUNDED)


@query(
    f"""WITH long AS ({unpivot_sql(LINEITEM_CATS, 'lineitem', 'VARCHAR')})
    SELECT "column", value, count(*) AS n, {r('count(*) / (SELECT count(*) FROM lineitem)', 3)} AS prob
    FROM long GROUP BY "column", value"""
)
def category_profile(spark, sf):
    return profile.category_profile(table(spark, sf, "lineitem"), LINEITEM_CATS)


@query(
    f"""WITH long AS ({unpivot_sql(['lang'], 'documents', 'VARCHAR', 'source,')})
    SELECT source, "column", value, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY source)', 3)} AS prob
    FROM long GROUP BY source, "column", value"""
)
def category_profile_per_key(spark, sf):
    return profile.category_profile(table(spark, sf, "documents"), ["lang"], ["source"])


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[0]}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c}::DOUBLE)"
    return text


def _norm_sql(z: str) -> str:
    y = f"abs({z})"
    tail = f"exp(-{y} * {y} / 2) * {_poly(y, NORM_TAIL_NUMERATOR)} / {_poly(y, NORM_TAIL_DENOMINATOR)}"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _fit_sql(source: str, cols: list[str]) -> str:
    return f"""WITH long AS ({unpivot_sql(cols, source, 'DOUBLE')}),
    fit AS (SELECT "column", count(*) AS rows, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi
            FROM long GROUP BY "column"),
    ranks AS (SELECT "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "column" ORDER BY value) AS upto
              FROM long GROUP BY "column", value),
    cdf AS (SELECT "column", m, s, lo, hi, upto / rows AS top, (upto - n) / rows AS bottom, (value - m) / s AS z,
              1 - exp(-(value - lo) / (m - lo)) AS e, (value - lo) / (hi - lo) AS u
            FROM ranks JOIN fit USING ("column")),
    norm AS (SELECT *, {_norm_sql('z')} AS p FROM cdf),
    ks AS (SELECT "column", any_value(m) AS m, any_value(s) AS s, any_value(lo) AS lo, any_value(hi) AS hi,
             max(greatest(top - p, p - bottom)) AS dn, max(greatest(top - e, e - bottom)) AS de,
             max(greatest(top - u, u - bottom)) AS du
           FROM norm GROUP BY "column"),
    best AS (SELECT *, CASE WHEN dn <= de AND dn <= du THEN 'norm' WHEN de <= du THEN 'expon' ELSE 'uniform' END AS kind FROM ks)
    SELECT "column", kind AS distribution, {r('least(dn, de, du)')} AS ks,
      {r("CASE kind WHEN 'norm' THEN m ELSE lo END")} AS loc,
      {r("CASE kind WHEN 'norm' THEN s WHEN 'expon' THEN m - lo ELSE hi - lo END")} AS scale,
      {r('dn')} AS ks_norm, {r('de')} AS ks_expon, {r('du')} AS ks_uniform
    FROM best"""


FIT = ["ks", "loc", "scale", "ks_norm", "ks_expon", "ks_uniform"]


@query(_fit_sql("lineitem", LINEITEM_CONTS))
def fit_distribution(spark, sf):
    return trimmed(profile.fit_distribution(table(spark, sf, "lineitem"), LINEITEM_CONTS), 6, *FIT)


@query(_fit_sql("events", ["value"]))
def fit_distribution_events(spark, sf):
    events = table(spark, sf, "events")
    return trimmed(profile.fit_distribution(events, ["value"], rows_per_part=max(1, events.count() // 5)), 6, *FIT)


@query()
def fit_modes(spark, sf):
    return profile.fit_modes(table(spark, sf, "lineitem"), LINEITEM_CONTS)


# Two narrow groups far apart: each mode is the mean, share and spread of its group.


@query(
    f"""WITH v AS (SELECT month(o_orderdate) > 6 AS late, CASE WHEN month(o_orderdate) > 6 THEN 1000 ELSE 10 END + {normal_sql(42, 'o_orderkey')} AS x FROM orders)
    SELECT 'x' AS "column", late::INTEGER AS mode, {r('avg(x)', 4)} AS mean, {r('count(*) / (SELECT count(*) FROM v)', 4)} AS weight, {r('stddev_pop(x)', 3)} AS std
    FROM v GROUP BY late"""
)
def fit_modes_separated(spark, sf):
    late = F.month("o_orderdate") > 6
    rows = table(spark, sf, "orders").select((F.when(late, 1000).otherwise(10) + standard_normal(42, "o_orderkey")).alias("x"))
    return trimmed(trimmed(profile.fit_modes(rows, ["x"]), 4, "mean", "weight"), 3, "std")


@query()
def fit_modes_per_key(spark, sf):
    return profile.fit_modes(table(spark, sf, "events"), ["value"], ["event_type"])


@query(
    f"""SELECT o_orderpriority AS value, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share,
      min(count(*)) OVER () AS smallest FROM orders GROUP BY o_orderpriority"""
)
def class_distribution(spark, sf):
    return trimmed(profile.class_distribution(table(spark, sf, "orders"), "o_orderpriority"), 6, "share")


@query(f"""WITH long AS ({unpivot_sql(['value'], 'events', 'DOUBLE', 'event_type,')}) {_moments_sql('event_type,')}""")
def numeric_profile_per_key_by_parts(spark, sf):
    """The path of large tables with keys."""
    events = table(spark, sf, "events")
    parts = profile.numeric_profile(events, ["value"], ["event_type"], rows_per_part=max(1, events.count() // 4))
    return trimmed(parts, PLACES, *ROUNDED)
