from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabweave.operators import association, shifts
from tabweave.session import durable
from workload.common import (
    LINEITEM_CATS, LINEITEM_CONTS, SALES_CATS, SALES_CONTS, SALES_ROLES, SALES_SQL, query, r, sales, table, trimmed,
)


def _mirror(sql: str) -> str:
    return f"""SELECT "column", other, value FROM ({sql}) UNION ALL SELECT other, "column", value FROM ({sql})"""


def pearson_sql(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", '{b}' AS other, corr({a}, {b}) AS value FROM {source}""" for a, b in combinations(cols, 2)
    )


def cramers_sql(pairs: list[tuple[str, str]], source: str) -> str:
    """Chi-square over all cells, absent ones included, with Yates' correction on 2x2 tables."""
    parts = []
    for a, b in pairs:
        parts.append(f"""SELECT '{a}' AS "column", '{b}' AS other, (
          WITH x AS (SELECT {a} AS v, count(*) AS c FROM {source} GROUP BY 1),
               y AS (SELECT {b} AS w, count(*) AS c FROM {source} GROUP BY 1),
               o AS (SELECT {a} AS v, {b} AS w, count(*) AS c FROM {source} GROUP BY 1, 2),
               t AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT count(*) FROM x) AS rx, (SELECT count(*) FROM y) AS ry),
               g AS (SELECT coalesce(o.c, 0) AS obs, x.c * y.c / n AS e, n, rx, ry
                     FROM x CROSS JOIN y CROSS JOIN t LEFT JOIN o ON o.v = x.v AND o.w = y.w)
          SELECT CASE WHEN any_value(least(rx, ry)) > 1 THEN sqrt(
            sum(CASE WHEN rx = 2 AND ry = 2 THEN greatest(abs(obs - e) - 0.5, 0) ** 2 ELSE (obs - e) ** 2 END / e)
            / (any_value(n) * (any_value(least(rx, ry)) - 1))) END FROM g) AS value""")
    return " UNION ALL ".join(parts)


def eta_sql(cats: list[str], conts: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", '{x}' AS other, (
          SELECT sqrt(sum(n * (m - w) ** 2) / any_value(ss)) FROM (
            SELECT count({x}) AS n, avg({x}) AS m FROM {source} GROUP BY {a})
          CROSS JOIN (SELECT avg({x}) AS w, var_pop({x}) * count({x}) AS ss FROM {source})) AS value"""
        for a in cats for x in conts
    )


def matrix(sql: str, places: int = 6, source: str = "") -> str:
    return f"""{'WITH ' + source if source else ''} SELECT "column", other, {r('value', places)} AS value FROM ({sql})"""


@query(matrix(_mirror(pearson_sql(LINEITEM_CONTS, "lineitem"))))
def pearson_matrix(spark, sf):
    return trimmed(association.pearson_matrix(table(spark, sf, "lineitem"), LINEITEM_CONTS), 6, "value")


@query(matrix(_mirror(cramers_sql([("l_returnflag", "l_linestatus")], "lineitem"))))
def cramers_v_matrix(spark, sf):
    return trimmed(association.cramers_v_matrix(table(spark, sf, "lineitem"), LINEITEM_CATS), 6, "value")


@query(matrix(_mirror(cramers_sql([("quality", "toxic")], "labels"))))
def cramers_v_yates(spark, sf):
    """A 2x2 table, where the correction applies."""
    return trimmed(association.cramers_v_matrix(table(spark, sf, "labels"), ["quality", "toxic"]), 6, "value")


@query(matrix(_mirror(cramers_sql([("p_brand", "p_type")], "part"))))
def cramers_v_brands(spark, sf):
    return trimmed(association.cramers_v_matrix(table(spark, sf, "part"), ["p_brand", "p_type"]), 6, "value")


@query(matrix(_mirror(cramers_sql(list(combinations(SALES_CATS, 2)), "sales")), 6, SALES_SQL))
def cramers_v_absent_cells(spark, sf):
    """Half-year and quarter share few cells: most label pairs never occur."""
    return trimmed(association.cramers_v_matrix(sales(spark, sf), SALES_CATS), 6, "value")


@query(matrix(_mirror(eta_sql(LINEITEM_CATS, LINEITEM_CONTS, "lineitem"))))
def eta_matrix(spark, sf):
    return trimmed(association.eta_matrix(table(spark, sf, "lineitem"), LINEITEM_CATS, LINEITEM_CONTS), 6, "value")


@query(matrix(eta_sql(["lang", "source"], ["n_chars"], "documents")))
def eta_matrix_one_sided(spark, sf):
    documents = table(spark, sf, "documents")
    return trimmed(association.eta_matrix(documents, ["lang", "source"], ["n_chars"], symmetric=False), 6, "value")


@query(
    f"""WITH {SALES_SQL}, s AS (SELECT band, month > 6 AS late FROM sales),
    cells AS (SELECT band, late, count(*) AS n FROM s GROUP BY ALL),
    sides AS (SELECT late, count(*) AS size FROM s GROUP BY ALL), classes AS (SELECT band, count(*) AS n FROM s GROUP BY ALL)
    SELECT 'band' AS "column", 'late' AS other, {r("1 - (SELECT sum(n * ln(n / size)) FROM cells JOIN sides USING (late)) / (SELECT sum(n * ln(n / (SELECT count(*) FROM s))) FROM classes)", 5)} AS value"""
)
def pseudo_r2_two_values(spark, sf):
    """On a column of two values the fitted probabilities are the shares, so the likelihoods are counts."""
    rows = sales(spark, sf).withColumn("late", F.when(F.col("month") > 6, 1).otherwise(0))
    return trimmed(association.pseudo_r2(rows, "band", "late"), 5, "value")


@query()
def pseudo_r2(spark, sf):
    return association.pseudo_r2(sales(spark, sf), "band", "month")


EDGES_SQL = f"""
matrix AS (
  SELECT "column", other, 'pearson' AS kind, value FROM ({_mirror(pearson_sql(SALES_CONTS, 'sales'))})
  UNION ALL SELECT "column", other, 'cramers_v', value FROM ({_mirror(cramers_sql(list(combinations(SALES_CATS, 2)), 'sales'))})
  UNION ALL SELECT "column", other, 'eta', value FROM ({_mirror(eta_sql(SALES_CATS, SALES_CONTS, 'sales'))})),
edges AS (SELECT "column", other, kind, {r('value', 2)} AS value FROM matrix WHERE abs(value) > 0.2)"""


@query(f"WITH {SALES_SQL}, {EDGES_SQL} SELECT * FROM edges")
def association_edges(spark, sf):
    return association.association_edges(sales(spark, sf), SALES_ROLES)


def sales_edges(spark, sf):
    """The few edges, written once because the steps that follow read them many times."""
    return durable(association_edges(spark, sf))


def _names(cols: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in cols) + ")"


def _long(cols: list[str], kind: str) -> str:
    return " UNION ALL ".join(f"SELECT id, '{c}' AS c, CAST({c} AS {kind}) AS v FROM sales" for c in cols)


SHIFT_TABLES = f"""
cats AS ({_long(SALES_CATS, 'VARCHAR')}),
nums AS ({_long(SALES_CONTS, 'DOUBLE')}),
total AS (SELECT count(*) AS rows FROM sales),
labels AS (SELECT c, v, count(*) AS n FROM cats GROUP BY 1, 2)"""

CAT_CAT_SQL = f"""
cat_cat AS (
  SELECT e."column", e.other, o.v AS condition, l.v AS value,
    {r('coalesce(x.n, 0) / o.n - l.n / rows', 3)} AS shift
  FROM edges e JOIN labels l ON l.c = e."column" JOIN labels o ON o.c = e.other CROSS JOIN total
  LEFT JOIN (SELECT a.c AS ca, b.c AS cb, a.v AS va, b.v AS vb, count(*) AS n
             FROM cats a JOIN cats b ON a.id = b.id AND a.c <> b.c GROUP BY 1, 2, 3, 4) x
    ON x.ca = e."column" AND x.cb = e.other AND x.va = l.v AND x.vb = o.v
  WHERE e."column" IN {_names(SALES_CATS)} AND e.other IN {_names(SALES_CATS)})"""

CAT_CONT_SQL = f"""
medians AS (SELECT c, median(v) AS m FROM nums GROUP BY c),
halves AS (SELECT id, c, CASE WHEN v >= m THEN 'big' ELSE 'small' END AS h FROM nums JOIN medians USING (c)),
half_sizes AS (SELECT c, h, count(*) AS n FROM halves GROUP BY 1, 2),
both_halves AS (SELECT c, h FROM medians, (SELECT unnest(['big', 'small']) AS h)),
cat_cont AS (
  SELECT e."column", e.other, b.h AS condition, l.v AS value,
    {r('coalesce(x.n, 0) / greatest(coalesce(s.n, 0), 1) - l.n / rows', 3)} AS shift
  FROM edges e JOIN labels l ON l.c = e."column" JOIN both_halves b ON b.c = e.other CROSS JOIN total
  LEFT JOIN half_sizes s ON s.c = b.c AND s.h = b.h
  LEFT JOIN (SELECT k.c AS ca, q.c AS cb, k.v AS va, q.h AS hb, count(*) AS n
             FROM cats k JOIN halves q ON k.id = q.id GROUP BY 1, 2, 3, 4) x
    ON x.ca = e."column" AND x.cb = e.other AND x.va = l.v AND x.hb = b.h
  WHERE e."column" IN {_names(SALES_CATS)})"""

CONT_CAT_SQL = f"""
whole AS (SELECT c, avg(v) AS m, stddev_samp(v) AS s FROM nums GROUP BY c),
cont_cat AS (
  SELECT e."column", e.other, g.label, {r('g.m - w.m', 2)} AS mean_shift, {r('g.s - w.s', 2)} AS std_shift
  FROM edges e JOIN whole w ON w.c = e."column"
  JOIN (SELECT n.c AS cn, k.c AS ck, k.v AS label, avg(n.v) AS m, stddev_samp(n.v) AS s
        FROM nums n JOIN cats k ON n.id = k.id GROUP BY 1, 2, 3) g ON g.cn = e."column" AND g.ck = e.other
  WHERE e.other IN {_names(SALES_CATS)})"""

_ALL = f"WITH {SALES_SQL}, {EDGES_SQL}, {SHIFT_TABLES}"


@query(f"{_ALL}, {CAT_CAT_SQL} SELECT * FROM cat_cat")
def cat_given_cat(spark, sf):
    return shifts.cat_given_cat(sales(spark, sf), sales_edges(spark, sf), SALES_ROLES)


@query(
    f"""{_ALL}, {CAT_CAT_SQL} SELECT c.* FROM cat_cat c SEMI JOIN
      (SELECT a.c AS x, b.c AS y, a.v AS xv, b.v AS yv FROM cats a JOIN cats b ON a.id = b.id) s
      ON s.x = c."column" AND s.y = c.other AND s.xv = c.value AND s.yv = c.condition"""
)
def cat_given_cat_observed(spark, sf):
    """Only label combinations that occur."""
    return shifts.cat_given_cat(sales(spark, sf), sales_edges(spark, sf), SALES_ROLES, observed_only=True)


@query(f"{_ALL}, {CAT_CONT_SQL} SELECT * FROM cat_cont")
def cat_given_cont(spark, sf):
    return shifts.cat_given_cont(sales(spark, sf), sales_edges(spark, sf), SALES_ROLES)


@query(f"{_ALL}, {CONT_CAT_SQL} SELECT * FROM cont_cat")
def cont_given_cat(spark, sf):
    return shifts.cont_given_cat(sales(spark, sf), sales_edges(spark, sf), SALES_ROLES)
