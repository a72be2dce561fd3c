from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabweave.operators import fidelity, prepare, privacy, utility
from tabweave.operators.neighbours import nearest_distances as nearest
from tabweave.session import durable
from tabweave.plans.scoring import default_metrics, score_table, with_control
from workload.associations import cramers_sql, eta_sql, pearson_sql
from workload.conversations import MODEL_ROWS, MODEL_SEED, card_model, generated_sql
from workload.common import LINEITEM_CONTS, SALES_CATS, SALES_CONTS, SALES_ROLES, SALES_SQL, hash_sql, query, r, sales, table, trimmed

# The control comparison: the shuffled training part plays the synthetic rows, the test part the real ones.
SPLIT_SQL = f"""{SALES_SQL},
shuffled AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'id')}, id) AS rn, count(*) OVER () AS n FROM sales),
train AS (SELECT * FROM shuffled WHERE rn <= floor(n * 0.75)),
test AS (SELECT * FROM shuffled WHERE rn > floor(n * 0.75) AND rn <= floor(n * 0.75) + floor(n * 0.25))"""


def parts(spark, sf):
    split = prepare.train_test_split(sales(spark, sf), 10**12, 10**12, key=["id"])
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


@query(
    "SELECT " + ", ".join(f"{r(f'(l.{c} - m_{c}) / s_{c}')} AS {c}" for c in LINEITEM_CONTS) + " FROM lineitem l CROSS JOIN (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_CONTS) + " FROM lineitem)"
)
def standard_scale(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINEITEM_CONTS)
    return trimmed(fidelity.standard_scale(lines, lines, LINEITEM_CONTS), 6, *LINEITEM_CONTS)


def _prediction(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("prediction"))


@query(
    f"""WITH c AS (SELECT unnest([0, 1]) AS k)
    SELECT {r('avg(2 * h / (a + g))')} AS score FROM (
      SELECT k, count(*) FILTER (quality = k AND toxic = k) AS h, count(*) FILTER (quality = k) AS a, count(*) FILTER (toxic = k) AS g
      FROM labels CROSS JOIN c GROUP BY k)"""
)
def f1_macro(spark, sf):
    return trimmed(utility.f1_macro(_prediction(spark, sf)), 6, "score")


@query(f"SELECT {r('avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END)')} AS score FROM labels")
def accuracy(spark, sf):
    return trimmed(utility.accuracy(_prediction(spark, sf)), 6, "score")


@query(f"SELECT {r('avg((quality - toxic) ** 2)')} AS score FROM labels")
def mse(spark, sf):
    return trimmed(utility.mse(_prediction(spark, sf)), 6, "score")


_CORR = lambda source: " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM {source}" for a in SALES_CONTS for b in SALES_CONTS
)


@query(f"WITH {SPLIT_SQL} SELECT {r('avg(abs(x.v - y.v))')} AS score FROM ({_CORR('test')}) x JOIN ({_CORR('train')}) y USING (a, b)")
def correlation_gap(spark, sf):
    train, test = parts(spark, sf)
    return trimmed(fidelity.correlation_gap(test, train, SALES_CONTS), 6, "score")


@query(
    f"""WITH {SPLIT_SQL} SELECT {r('avg(abs(x.v - y.v))')} AS score FROM ({_CORR('test')}) x JOIN ({_CORR('train')}) y USING (a, b)
    WHERE a = 'duty' AND b <> 'duty'"""
)
def target_correlation_gap(spark, sf):
    train, test = parts(spark, sf)
    return trimmed(fidelity.target_correlation_gap(test, train, SALES_CONTS, "duty"), 6, "score")


def _mixed(source: str) -> str:
    pairs = list(combinations(SALES_CATS, 2))
    off = " UNION ALL ".join([pearson_sql(SALES_CONTS, source), cramers_sql(pairs, source), eta_sql(SALES_CATS, SALES_CONTS, source)])
    on = cramers_sql([(c, c) for c in SALES_CATS], source)
    return f"""SELECT "column", other, value FROM ({off}) UNION ALL SELECT other, "column", value FROM ({off}) UNION ALL {on}
      UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', '{c}', corr({c}, {c}) FROM {source}" for c in SALES_CONTS)


@query(
    f"""WITH {SPLIT_SQL} SELECT {r('avg(abs(coalesce(x.value, 0) - coalesce(y.value, 0)))')} AS score
    FROM ({_mixed('test')}) x JOIN ({_mixed('train')}) y USING ("column", other)"""
)
def mixed_correlation_gap(spark, sf):
    train, test = parts(spark, sf)
    return trimmed(fidelity.mixed_correlation_gap(test, train, SALES_ROLES), 6, "score")


@query(
    f"""WITH {SALES_SQL}, {{}}""".format("")
    + f"""a AS (SELECT p_size AS x, row_number() OVER (ORDER BY p_partkey) AS rn FROM part),
    b AS (SELECT month AS x, row_number() OVER (ORDER BY id) AS rn FROM sales),
    j AS (SELECT a.x / sum(a.x) OVER () AS p, b.x / sum(b.x) OVER () AS q FROM a JOIN b USING (rn))
    SELECT {r('sqrt(sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / ((p + q) / 2)) END + CASE WHEN q = 0 THEN 0 ELSE q * ln(q / ((p + q) / 2)) END) / 2)')} AS score FROM j"""
)
def jensen_shannon(spark, sf):
    """Part sizes against order months, position by position."""
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"))
    months = sales(spark, sf).select("id", F.col("month").alias("x"))
    return trimmed(fidelity.jensen_shannon(sizes, months, ["x"], ["id"]), 6, "score")


_WD = """u AS (SELECT {x} AS v FROM {a}), w AS (SELECT {y} AS v FROM {b}),
  vals AS (SELECT v, sum(u) AS u, sum(w) AS w FROM (SELECT v, 1 AS u, 0 AS w FROM u UNION ALL SELECT v, 0, 1 FROM w) GROUP BY v),
  cdf AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(u) OVER (ORDER BY v) / sum(u) OVER () AS fu, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS fw FROM vals)"""


@query(
    "WITH " + _WD.format(a="customer", b="supplier", x="c_acctbal", y="s_acctbal")
    + f"""SELECT 'balance' AS "column", {r('sum(abs(fu - fw) * (nv - v))')} AS distance FROM cdf"""
)
def wasserstein(spark, sf):
    ours = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"))
    theirs = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    return trimmed(fidelity.wasserstein(ours, theirs, ["balance"]), 6, "distance")


@query(
    "WITH " + _WD.format(
        a="(SELECT * FROM customer ORDER BY c_custkey LIMIT (SELECT least((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier))))",
        b="supplier", x="c_acctbal", y="s_acctbal")
    + f"SELECT {r('sum(abs(fu - fw) * (nv - v))')} AS score FROM cdf"
)
def wasserstein_equal_length(spark, sf):
    """Both sides cut to the shorter one, in key order, as the metric defines it."""
    ours = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    theirs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return trimmed(fidelity.mean_wasserstein(ours, theirs, ["balance"], order=["id"]), 6, "score")


@query(
    "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer), "
    + _WD.format(a="customer CROSS JOIN s", b="supplier CROSS JOIN s", x="(c_acctbal - m) / d", y="(s_acctbal - m) / d")
    + f"""SELECT 'balance' AS "column", {r('sum(abs(fu - fw) * (nv - v))')} AS distance FROM cdf"""
)
def wasserstein_scaled(spark, sf):
    ours = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"))
    theirs = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    scaler = fidelity.fit_scaler(ours, ["balance"])
    parts_ = fidelity.wasserstein(ours, theirs, ["balance"], scaler=scaler, rows_per_part=max(1, ours.count() // 4))
    return trimmed(parts_, 6, "distance")


_LINE = ["l_suppkey", "l_linenumber", "l_quantity", "l_tax"]


@query(f"SELECT {', '.join(_LINE)} FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def drop_all_duplicates(spark, sf):
    return privacy.drop_all_duplicates(table(spark, sf, "lineitem"), _LINE)


@query(f"SELECT floor((sum(n) - count(*)) * 1000 / sum(n))::DOUBLE AS score FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_LINE)})")
def duplicates_per_mille(spark, sf):
    return privacy.duplicates_per_mille(table(spark, sf, "lineitem"), _LINE)


def _accounts(spark, sf):
    ours = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    theirs = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return ours, theirs


_ACCOUNTS_SQL = """c AS (SELECT c_custkey, c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer),
  s AS (SELECT s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier)"""
_DISTANCE = "sqrt((a.nation - b.nation) ** 2 + (a.balance - b.balance) ** 2)"
_NEAREST = f"""WITH {_ACCOUNTS_SQL},
  d AS (SELECT c_custkey, {_DISTANCE} AS d FROM c a CROSS JOIN s b),
  k AS (SELECT c_custkey, list_sort(list(d)) AS l FROM d GROUP BY 1)
  SELECT c_custkey, {r('l[1]')} AS d1, {r('l[2]')} AS d2 FROM k"""


@query(_NEAREST)
def nearest_distances(spark, sf):
    ours, theirs = _accounts(spark, sf)
    return trimmed(nearest(ours, theirs, ["nation", "balance"], 2, ["c_custkey"]), 6, "d1", "d2")


@query(_NEAREST)
def nearest_distances_blocks(spark, sf):
    """The path of large right sides: blocks of nearby points, pruned by their bounding boxes."""
    ours, theirs = _accounts(spark, sf)
    found = nearest(ours, theirs, ["nation", "balance"], 2, ["c_custkey"], broadcast_points=0, block_points=16, chunk_points=200)
    return trimmed(found, 6, "d1", "d2")


_SCALED = lambda source, cols: "SELECT " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in cols) + f" FROM {source}"


@query(
    f"""WITH {_ACCOUNTS_SQL},
    u AS (SELECT nation, balance FROM c GROUP BY ALL HAVING count(*) = 1), v AS (SELECT nation, balance FROM s GROUP BY ALL HAVING count(*) = 1),
    a AS (SELECT row_number() OVER () AS id, * FROM ({_SCALED('u', ['nation', 'balance'])})), b AS ({_SCALED('v', ['nation', 'balance'])})
    SELECT {r('quantile_cont(d, 0.05)')} AS score FROM (SELECT min({_DISTANCE}) AS d FROM a CROSS JOIN b GROUP BY id)"""
)
def dcr_p5(spark, sf):
    ours, theirs = _accounts(spark, sf)
    return trimmed(privacy.dcr_p5([ours], theirs, ["nation", "balance"]), 6, "score")


@query(
    f"""WITH {_ACCOUNTS_SQL},
    a AS (SELECT row_number() OVER () AS id, * FROM ({_SCALED('s', ['nation', 'balance'])})), b AS ({_SCALED('c', ['nation', 'balance'])})
    SELECT {r('avg(d)')} AS score FROM (SELECT min({_DISTANCE}) AS d FROM a CROSS JOIN b GROUP BY id)"""
)
def dcr_mean(spark, sf):
    ours, theirs = _accounts(spark, sf)
    return trimmed(privacy.dcr_mean([ours], theirs, ["nation", "balance"]), 6, "score")


_GAP = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in SALES_CONTS) + ")"


@query(
    f"""WITH {SPLIT_SQL},
    a AS (SELECT row_number() OVER () AS at, * FROM ({_SCALED('train', SALES_CONTS)})), b AS ({_SCALED('test', SALES_CONTS)})
    SELECT {r('avg(d)')} AS score FROM (SELECT min({_GAP}) AS d FROM a CROSS JOIN b GROUP BY a.at)"""
)
def dcr_mean_orders(spark, sf):
    """Training orders against test orders; both sides grow with the table."""
    train, test = parts(spark, sf)
    return trimmed(privacy.dcr_mean([test], train, SALES_CONTS), 6, "score")


def _classify(model):
    def run(spark, sf):
        train, test = parts(spark, sf)
        code = F.when(F.col("band") == "low", 0).when(F.col("band") == "middle", 1).otherwise(2)
        return utility.f1_macro(
            utility.utility_classification(
                train.withColumn("target", code), test.withColumn("target", code), SALES_CONTS, model
            )
        ).withColumn("model", F.lit(model))

    return run


# Closed forms of a one-feature fit on centred sums.
_REGRESS = """WITH {split},
  g AS (SELECT avg(price) AS mx, avg(duty) AS my, count(*) AS n, regr_sxx(duty, price) AS sxx, regr_sxy(duty, price) AS sxy FROM train),
  f AS (SELECT mx, my, {slope} AS b FROM g)
  SELECT {score} AS score FROM test CROSS JOIN f"""
_SLOPES = {
    "LinearRegression": "sxy / sxx",
    "Ridge": "sxy / (sxx + 1)",
    "Lasso": "greatest(sxy / n - 1, 0) / (sxx / n)",
}


def _regress(model):
    def run(spark, sf):
        train, test = parts(spark, sf)
        scaled = F.col("price") / 100000, F.col("duty") / 10000
        a, b = (d.select(scaled[0].alias("price"), scaled[1].alias("duty")) for d in (train, test))
        return trimmed(utility.mse(utility.utility_regression(a, b, ["price"], model, "duty")), 5, "score")

    return run


for _model in utility.CLASSIFIERS:
    query(name=f"utility_{_model}")(_classify(_model))
for _model, _slope in _SLOPES.items():
    _sql = _REGRESS.format(
        split=SPLIT_SQL.replace("SELECT * FROM shuffled", "SELECT price / 100000 AS price, duty / 10000 AS duty FROM shuffled"),
        slope=_slope, score=r("avg((duty - (my + b * (price - mx))) ** 2)", 5),
    )
    query(_sql, name=f"utility_{_model}")(_regress(_model))


# With two features the ridge system and its eigenvalues have closed forms.
_SCALED_TWO = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SALES_CONTS)


@query(
    f"""WITH RECURSIVE {SPLIT_SQL},
    z AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SALES_CONTS)} FROM train),
    x AS (SELECT price AS p, month AS m, duty AS y FROM (SELECT {_SCALED_TWO} FROM train CROSS JOIN z)),
    t AS (SELECT price AS p, month AS m, duty AS y FROM (SELECT {_SCALED_TWO} FROM test CROSS JOIN z)),
    g AS (SELECT count(*)::DOUBLE AS n, avg(p) AS ap, avg(m) AS am, avg(y) AS ay, n * var_pop(p) AS pp, n * var_pop(m) AS mm, n * covar_pop(p, m) AS pm,
      n * covar_pop(p, y) AS py, n * covar_pop(m, y) AS my, n * var_pop(y) AS yy,
      (pp + mm) / 2 + sqrt((pp - mm) ** 2 / 4 + pm * pm) AS e1, (pp + mm) / 2 - sqrt((pp - mm) ** 2 / 4 + pm * pm) AS e2 FROM x),
    steps AS (
      SELECT 0 AS i, 1 / (yy / n + 2.220446049250313e-16) AS alpha, 1::DOUBLE AS lam, 0::DOUBLE AS wp, 0::DOUBLE AS wm, 1::DOUBLE AS moved FROM g
      UNION ALL
      SELECT i + 1, (n - eff + 2e-6) / (greatest(yy - 2 * (vp * py + vm * my) + vp * vp * pp + 2 * vp * vm * pm + vm * vm * mm, 0) + 2e-6),
        (eff + 2e-6) / (vp * vp + vm * vm + 2e-6), vp, vm, abs(vp - wp) + abs(vm - wm)
      FROM (SELECT *, alpha * e1 / (lam + alpha * e1) + alpha * e2 / (lam + alpha * e2) AS eff, lam / alpha AS k,
          (py * (mm + k) - my * pm) / ((pp + k) * (mm + k) - pm * pm) AS vp, (my * (pp + k) - py * pm) / ((pp + k) * (mm + k) - pm * pm) AS vm
        FROM steps CROSS JOIN g) WHERE moved >= 1e-3 AND i < 300),
    f AS (SELECT ap, am, ay, lam / alpha AS k, (py * (mm + k) - my * pm) / ((pp + k) * (mm + k) - pm * pm) AS bp,
      (my * (pp + k) - py * pm) / ((pp + k) * (mm + k) - pm * pm) AS bm FROM steps CROSS JOIN g ORDER BY i DESC LIMIT 1)
    SELECT {r("avg((y - (ay + bp * (p - ap) + bm * (m - am))) ** 2)", 5)} AS score FROM t CROSS JOIN f"""
)
def utility_BayesianRidge(spark, sf):
    train, test = parts(spark, sf)
    scaler = fidelity.fit_scaler(train, SALES_CONTS)
    pred = utility.utility_regression(train, test, ["price", "month"], "BayesianRidge", "duty", scaler)
    return trimmed(utility.mse(pred), 5, "score")


def _separable(model):
    def run(spark, sf):
        train, test = (p.filter("month <= 3 OR month >= 10") for p in parts(spark, sf))
        rows = [p.select((F.col("month") / 10).alias("x"), (F.col("price") / 500000).alias("y"), F.when(F.col("month") > 6, 1).otherwise(0).alias("target")) for p in (train, test)]
        found = utility.utility_classification(*rows, ["x", "y"], model)
        return found.groupBy("label", "prediction").agg(F.count("*").alias("n"))

    return run


# Classes with a wide gap between them: whatever a model's optimum is, it lies in the gap, and every test row is right.
for _model in ("LinearSVC", "LogisticRegression", "RandomForestClassifier", "MLPClassifier"):
    query(
        f"""WITH {SPLIT_SQL} SELECT (month > 6)::DOUBLE AS label, (month > 6)::DOUBLE AS prediction, count(*) AS n
        FROM test WHERE month <= 3 OR month >= 10 GROUP BY 1, 2""",
        name=f"utility_separable_{_model}",
    )(_separable(_model))


# With one feature the evidence iteration is one of numbers.
@query(
    f"""WITH RECURSIVE {SPLIT_SQL.replace("SELECT * FROM shuffled", "SELECT price / 100000 AS x, duty / 10000 AS y FROM shuffled")},
    g AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS xx, count(*) * covar_pop(x, y) AS xy, count(*) * var_pop(y) AS yy FROM train),
    steps AS (
      SELECT 0 AS i, 1 / (yy / n + 2.220446049250313e-16) AS alpha, 1::DOUBLE AS lam, 0::DOUBLE AS w, 1::DOUBLE AS moved FROM g
      UNION ALL
      SELECT i + 1, (n - alpha * xx / (lam + alpha * xx) + 2e-6) / (greatest(yy - 2 * v * xy + v * v * xx, 0) + 2e-6),
        (alpha * xx / (lam + alpha * xx) + 2e-6) / (v * v + 2e-6), v, abs(v - w)
      FROM (SELECT *, xy / (xx + lam / alpha) AS v FROM steps CROSS JOIN g) WHERE moved >= 1e-3 AND i < 300),
    f AS (SELECT xy / (xx + lam / alpha) AS b, mx, my FROM steps CROSS JOIN g ORDER BY i DESC LIMIT 1)
    SELECT {r("avg((y - (my + b * (x - mx))) ** 2)", 5)} AS score FROM test CROSS JOIN f"""
)
def utility_bayesian_ridge_one_feature(spark, sf):
    train, test = (p.select((F.col("price") / 100000).alias("x"), (F.col("duty") / 10000).alias("y")) for p in parts(spark, sf))
    return trimmed(utility.mse(utility.utility_regression(train, test, ["x"], "BayesianRidge", "y")), 5, "score")


# Least squares with two features from their centred products.
_TWO = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SALES_CONTS)


@query(
    f"""WITH {SPLIT_SQL},
    z AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SALES_CONTS)} FROM train),
    x AS (SELECT price AS p, month AS m, trunc(duty) AS y FROM (SELECT {_TWO} FROM train CROSS JOIN z)),
    t AS (SELECT price AS p, month AS m, duty AS y FROM (SELECT {_TWO} FROM test CROSS JOIN z)),
    g AS (SELECT avg(p) AS ap, avg(m) AS am, avg(y) AS ay, var_pop(p) AS pp, var_pop(m) AS mm, covar_pop(p, m) AS pm,
      covar_pop(p, y) AS py, covar_pop(m, y) AS my FROM x),
    f AS (SELECT *, (py * mm - my * pm) / (pp * mm - pm * pm) AS bp, (my * pp - py * pm) / (pp * mm - pm * pm) AS bm FROM g)
    SELECT {r("avg((y - (ay + bp * (p - ap) + bm * (m - am))) ** 2)", 5)} AS score FROM t CROSS JOIN f"""
)
def utility_truncated_target(spark, sf):
    train, test = parts(spark, sf)
    scaler = fidelity.fit_scaler(train, SALES_CONTS)
    pred = utility.utility_regression(train, test, ["price", "month"], "LinearRegression", "duty", scaler, truncate_target=True)
    return trimmed(utility.mse(pred), 5, "score")


@query(
    f"""WITH {SPLIT_SQL}, c AS (SELECT DISTINCT month > 6 AS late FROM test)
    SELECT {r("avg(2 * h / (a + g))")} AS score FROM (
      SELECT late, count(*) FILTER ((month > 6) = late) AS h, count(*) FILTER ((month > 6) = late) AS a,
        count(*) FILTER ((month > 6) = late) AS g FROM test CROSS JOIN c GROUP BY late)"""
)
def utility_tree_one_threshold(spark, sf):
    """A target that one threshold separates: the tree finds it, and every test row is right."""
    train, test = parts(spark, sf)
    late = F.when(F.col("month") > 6, 1).otherwise(0)
    pred = utility.utility_classification(
        train.withColumn("target", late), test.withColumn("target", late), ["month", "price"], "DecisionTreeClassifier"
    )
    return trimmed(utility.f1_macro(pred), 6, "score")


# Three repetitions of generated rows beside the real training rows; the profile is that of the whole table.
_RUN_SPLIT = SPLIT_SQL.replace("floor(n * 0.75)", "least(1500, floor(n * 0.75))").replace("floor(n * 0.25)", "least(500, floor(n * 0.25))")
_RUN_ROWS = "(SELECT count(*) FROM train)"


def _run_score(name: str, repetition: str, source: str) -> str:
    gap = f"(SELECT avg(abs(x.v - y.v)) FROM ({_CORR('test')}) x JOIN ({_CORR(source)}) y USING (a, b))"
    copies = f"(SELECT floor((sum(n) - count(*)) * 1000 / sum(n)) FROM (SELECT count(*) AS n FROM {source} GROUP BY {', '.join(SALES_CONTS)}))"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS model, {repetition}::INTEGER AS repetition, '{metric}' AS metric, '{metric.split('-')[1]}' AS grp, {r(value)} AS score, CAST(NULL AS VARCHAR) AS error"
        for metric, value in (("correlation-Corr", gap), ("privacy-Dub", copies))
    )


@query(
    generated_sql("ceil(need / 16)::BIGINT", f"SELECT 3 * {_RUN_ROWS} AS need", SALES_CONTS, _RUN_SPLIT).replace(")\n    SELECT batch, chat_id, j::INTEGER", "),\n    made AS (SELECT batch, chat_id, j::INTEGER", 1)
    + f"""), placed AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'batch', 'chat_id', 'position')}, batch, chat_id, position) AS k FROM made),
    {", ".join(f"rep{i} AS (SELECT * FROM placed WHERE k > {i} * {_RUN_ROWS} AND k <= {i + 1} * {_RUN_ROWS})" for i in range(3))}
    """
    + " UNION ALL ".join([*[_run_score("synthetic", str(i), f"rep{i}") for i in range(3)], _run_score("GT", "0", "train")])
)
def evaluation_run(spark, sf):
    """From the raw table to scores: profile, split, generation by a model that reads its cards, slices, scores."""
    from tabweave.plans.evaluation import evaluate
    from tabweave.plans.generating import generate_rows

    def generate(profile, count):
        return generate_rows(profile, card_model(MODEL_SEED, MODEL_ROWS), count, "json_relationships")

    cols = ["target" if c == "duty" else c for c in SALES_CONTS]
    chosen = [m for m in default_metrics(cols, "regression") if m[0] in ("correlation-Corr", "privacy-Dub")]
    run = evaluate(sales(spark, sf), {c: SALES_ROLES[c] for c in SALES_CONTS}, "duty", "regression", ["id"], generate, dropped=["half", "quarter"], metrics=chosen)
    return trimmed(run.scores, 6, "score")


_CODES = ", ".join(f"m_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY min(id), {c}) - 1 AS code FROM sales GROUP BY {c})" for c in SALES_CATS)
_CODED = f"""coded AS (SELECT {", ".join(f"m_{c}.code AS {c}" for c in SALES_CATS)}, {", ".join(SALES_CONTS)} FROM sales
  {" ".join(f"JOIN m_{c} ON m_{c}.v = sales.{c}" for c in SALES_CATS)})"""


@query(
    f"""WITH {SALES_SQL}, {_CODES}, {_CODED}, matrix AS ({" UNION ALL ".join(
        f"SELECT '{a}' AS " + '"column"' + f", '{b}' AS other, corr({a}, {b}) AS v FROM coded" for a in SALES_ROLES for b in SALES_ROLES if a != b)})
    SELECT "column", other, 'pearson' AS kind, {r('v', 2)} AS value FROM matrix WHERE abs(v) > 0.2"""
)
def cheap_profile_edges(spark, sf):
    """Associations of the cheap profile: correlations over category codes, no modes and no shifts."""
    from tabweave.plans.profiling import profile_table

    p = profile_table(sales(spark, sf), SALES_ROLES, "id", fast=True)
    if p.modes is not None or not (p.cat_shifts.isEmpty() and p.cont_shifts.isEmpty()):
        raise AssertionError("the cheap profile holds modes or shifts")
    return p.edges


@query()
def score_table_regression(spark, sf):
    """All default metrics on rows drawn from the marginals, and on the training part itself as control."""
    from tabweave.operators.sampling import sample_marginals

    # Every metric reads the parts again, so they are written once.
    train, test = (durable(p) for p in parts(spark, sf))
    synthetic = durable(sample_marginals(train, SALES_CONTS, train.count()))
    rename = lambda d: prepare.rename_target(d.select(*SALES_CONTS), "duty")
    cols = ["price", "month", "target"]
    scaler = durable(fidelity.fit_scaler(rename(train), cols))
    return score_table(with_control(rename(synthetic), rename(train)), rename(train), rename(test), default_metrics(cols, "regression", scaler=scaler))
