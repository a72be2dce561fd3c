from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.operators import fidelity, neighbours, privacy, utility
from tabweave.plans.scoring import default_metrics, metric_names, score_table, utility_metrics, with_control


def points(spark, array, names="abc"):
    return spark.createDataFrame([tuple(map(float, row)) for row in array], [n for n in names[: array.shape[1]]])


def brute(left, right, k):
    d = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    return np.sort(d, axis=1)[:, :k]


SMALL_BLOCKS = {"broadcast_points": 0, "block_points": 20, "chunk_points": 15}


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("options", [{}, SMALL_BLOCKS])
@pytest.mark.parametrize("shape", ["random", "hot", "line", "far"])
def test_nearest_equals_brute_force(spark, k, options, shape):
    rng = np.random.default_rng(k)
    left, right = rng.normal(size=(150, 3)), rng.normal(size=(200, 3))
    if shape == "hot":
        # A third of both sides is one point.
        left[:50], right[:70] = 0.25, 0.25
    elif shape == "line":
        left[:, 1:], right[:, 1:] = 0, 0
    elif shape == "far":
        left += 100
    df = points(spark, left).withColumn("id", F.monotonically_increasing_id())
    ids = {tuple(map(float, row)): None for row in left}
    got = neighbours.nearest_distances(df, points(spark, right), ["a", "b", "c"], k, ["id"], **options)
    joined = got.join(df, "id").collect()
    assert len(joined) == 150 and len(ids) <= 150
    want = {tuple(map(float, row)): d for row, d in zip(left, brute(left, right, k))}
    for r in joined:
        assert [r[f"d{i + 1}"] for i in range(k)] == pytest.approx(list(want[r.a, r.b, r.c]), abs=1e-12)


def clusters(seed, rows, columns=10, count=40):
    """Rows around a few centres, spread along three directions of their own."""
    rng = np.random.default_rng(9)
    centres, ways = rng.normal(size=(count, columns)) * 20, rng.normal(size=(count, 3, columns))
    rng = np.random.default_rng(seed)
    which = rng.integers(0, count, rows)
    return centres[which] + (rng.normal(size=(rows, 1, 3)) @ ways[which])[:, 0] + rng.normal(size=(rows, columns)) * 0.05


def test_search_meets_few_leaves():
    left, right = clusters(1, 500), clusters(2, 40_000)
    leaves = neighbours.build_leaves(right, np.ones(len(right), int))
    for k in (1, 3):
        found, met = neighbours.search(left, leaves, k)
        assert found == pytest.approx(np.sqrt(np.sort(((left[:, None] - right[None]) ** 2).sum(2), axis=1)[:, :k]), abs=1e-12)
        assert len(leaves.low) > 600 and met / len(left) / len(leaves.low) < 0.03


def test_points_beside_lines_meet_few_leaves():
    """Drawn columns lie off the lines that real rows lie on; boxes along the lines tell the leaves apart."""
    rng = np.random.default_rng(5)
    price, month = rng.uniform(0, 3.4, 20_000), rng.integers(0, 12, 20_000) * 0.29
    right = np.column_stack((price, 0.9 * price + 0.44 * month, month))
    left = np.column_stack([rng.choice(right[:, j], 400) for j in range(3)])
    leaves = neighbours.build_leaves(right, np.ones(len(right), int))
    for k in (1, 3):
        found, met = neighbours.search(left, leaves, k)
        brute = np.sort(np.linalg.norm(left[:, None] - right[None], axis=2), axis=1)[:, :k]
        assert np.allclose(found, brute, rtol=1e-12, atol=1e-12) and met < 8 * len(left)


@pytest.mark.parametrize("columns", [1, 2, 16, 17])
def test_search_equals_brute_force_at_any_width(columns):
    rng = np.random.default_rng(columns)
    right = np.vstack((rng.integers(0, 3, (700, columns)), np.outer(rng.normal(size=300), rng.normal(size=columns)) + 1e5))
    left = np.vstack((right[::50], rng.normal(size=(50, columns)) * 1e5))
    for k in (1, 2):
        found, _ = neighbours.search(left, neighbours.build_leaves(right, np.ones(len(right), int), 16), k)
        brute = np.sort(np.sqrt(((left[:, None] - right[None]) ** 2).sum(axis=2)), axis=1)[:, :k]
        assert np.allclose(found, brute, rtol=1e-12, atol=1e-9)


def test_search_measures_few_boxes(monkeypatch):
    """A point goes down a tree: it is not compared with the boxes of all leaves."""
    rng = np.random.default_rng(8)
    left, right = rng.uniform(size=(400, 3)), rng.uniform(size=(30_000, 3))
    leaves = neighbours.build_leaves(right, np.ones(len(right), int))
    cells = []
    whole = neighbours.box_distances
    monkeypatch.setattr(neighbours, "box_distances", lambda points, low, high: cells.append(len(points) * len(low)) or whole(points, low, high))
    found, met = neighbours.search(left, leaves, 1)
    assert found[:, 0] == pytest.approx(np.sqrt(((left[:, None] - right[None]) ** 2).sum(2)).min(1), abs=1e-12)
    assert sum(cells) < 0.1 * len(left) * len(leaves.low) and met / len(left) < 8


@pytest.mark.parametrize("rows", [1, 2, 63, 65, 129, 1_000])
def test_search_counts_no_row_twice(rows):
    """Leaves of equal width are filled up; what fills them is nobody's neighbour."""
    rng = np.random.default_rng(rows)
    left, right = rng.normal(size=(40, 3)), rng.normal(size=(rows, 3))
    left[0] = np.nan
    for leaf in (3, 64):
        found, _ = neighbours.search(left, neighbours.build_leaves(right, np.ones(rows, int), leaf), 3)
        want = brute(left[1:], right, 3)
        assert found[1:, : want.shape[1]] == pytest.approx(want) and np.isinf(found[0]).all() and np.isinf(found[:, rows:]).all()


def test_points_meet_few_blocks(spark):
    """Ten clustered columns: a few percent of the blocks per point, over all rounds."""
    left, right = clusters(3, 400), clusters(4, 12_000)
    names, visits = [f"c{i}" for i in range(10)], []
    sides = [spark.createDataFrame(pd.DataFrame(side, columns=names)) for side in (left, right)]
    got = neighbours.nearest_distances(*sides, names, 1, broadcast_points=0, block_points=60, visits=visits).collect()
    want = {tuple(row): d for row, d in zip(left.tolist(), brute(left, right, 1)[:, 0])}
    assert all(r.d1 == pytest.approx(want[tuple(r[n] for n in names)], abs=1e-12) for r in got) and len(got) == 400
    assert sum(visits) / 400 / 200 < 0.05


def test_large_blocks_are_searched_in_parts(spark):
    rng = np.random.default_rng(6)
    left, right = rng.normal(size=(60, 2)), rng.normal(size=(500, 2))
    options = {"broadcast_points": 0, "block_points": 200, "chunk_points": 7, "part_points": 30}
    got = neighbours.nearest_distances(points(spark, left), points(spark, right), ["a", "b"], 2, **options).collect()
    want = {tuple(row): d for row, d in zip(left.tolist(), brute(left, right, 2).tolist())}
    assert all([r.d1, r.d2] == pytest.approx(want[r.a, r.b]) for r in got) and len(got) == 60


@pytest.mark.parametrize("options", [{}, SMALL_BLOCKS])
def test_points_with_holes(spark, options):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "id int, a double, b double")
    right = spark.createDataFrame([(3.0, 4.0), (None, 0.0), (0.0, float("nan"))], "a double, b double")
    got = {r.id: r.d1 for r in neighbours.nearest_distances(left, right, ["a", "b"], 1, ["id"], **options).collect()}
    assert got == {1: 5.0, 2: None, 3: None}
    empty = neighbours.nearest_distances(left, right.limit(0), ["a", "b"], 1, ["id"], **options).collect()
    assert [r.d1 for r in empty] == [None] * 3


def test_nearest_collapses_copies(spark):
    left, right = np.array([[0.0], [0.0], [5.0]]), np.array([[1.0], [1.0], [9.0]])
    for options in ({}, {"broadcast_points": 0, "block_points": 1, "chunk_points": 1}):
        rows = neighbours.nearest_distances(points(spark, left), points(spark, right), ["a"], 2, **options).collect()
        assert sorted((r.a, r.copies, r.d1, r.d2) for r in rows) == [(0.0, 2, 1.0, 1.0), (5.0, 1, 4.0, 4.0)]


def test_fewer_neighbours_than_asked(spark):
    one = points(spark, np.array([[1.0]]))
    for options in ({}, {"broadcast_points": 0}):
        row = neighbours.nearest_distances(one, one, ["a"], 2, **options).first()
        assert row.d1 == 0.0 and row.d2 is None


@pytest.mark.parametrize("options", [{}, SMALL_BLOCKS])
def test_record_distances(spark, options):
    rng = np.random.default_rng(4)
    real, fake = rng.normal(size=(300, 2)), rng.normal(size=(120, 2)) * 2 + 1
    z = lambda a: (a - a.mean(0)) / a.std(0)
    parts = [points(spark, real[:200]), points(spark, real[200:])]
    p5 = privacy.dcr_p5(parts, points(spark, fake), ["a", "b"], **options).first().score
    assert p5 == pytest.approx(np.percentile(brute(z(real), z(fake), 1), 5))
    mean = privacy.dcr_mean(parts, points(spark, fake), ["a", "b"], **options).first().score
    assert mean == pytest.approx(brute(z(fake), z(real), 1).mean())


@pytest.mark.parametrize("rows_per_part", [10**6, 10])
def test_record_distances_of_copies_alone(spark, monkeypatch, rows_per_part):
    """Rows that all have copies leave no distance: one row without a score, however large the table."""
    from tabweave.functions import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_PART", rows_per_part)
    real = points(spark, np.repeat(np.random.default_rng(1).normal(size=(20, 2)), 2, axis=0))
    fake = points(spark, np.random.default_rng(2).normal(size=(30, 2)))
    assert [r.score for r in privacy.dcr_p5([real], fake, ["a", "b"]).collect()] == [None]


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (3,), (4,)], "a int")
    assert privacy.duplicates_per_mille(df).first().score == int(3000 / 7)
    assert sorted(r.a for r in privacy.drop_all_duplicates(df).collect()) == [2, 4]


@pytest.mark.parametrize("rows_per_part", [None, 30])
def test_wasserstein(spark, rows_per_part):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=200), np.round(rng.normal(1, 2, 150), 1)
    grid = np.sort(np.concatenate([u, v]))
    cdf = lambda s, x: np.searchsorted(np.sort(s), x, side="right") / len(s)
    want = (np.abs(cdf(u, grid[:-1]) - cdf(v, grid[:-1])) * np.diff(grid)).sum()
    a, b = points(spark, u[:, None]), points(spark, v[:, None])
    assert fidelity.wasserstein(a, b, ["a"], rows_per_part=rows_per_part).first().distance == pytest.approx(want)
    assert fidelity.wasserstein(a, a, ["a"], rows_per_part=rows_per_part).first().distance == pytest.approx(0)
    assert fidelity.wasserstein(a, b.limit(0), ["a"]).first().distance is None


def js(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0).sum()
    return math.sqrt((kl(p) + kl(q)) / 2)


def test_jensen_shannon(spark):
    p, q = np.array([1, 0, 3, 5, 2]), np.array([2, 2, 0, 1, 2, 9])
    a = spark.createDataFrame([(i, int(v)) for i, v in enumerate(p)], "id int, x int")
    b = spark.createDataFrame([(i, int(v)) for i, v in enumerate(q)], "id int, x int")
    assert fidelity.jensen_shannon(a, b, ["x"], ["id"]).first().score == pytest.approx(js(p, q[:5]))
    assert fidelity.jensen_shannon(a, a, ["x"], ["id"]).first().score == pytest.approx(0)
    assert math.isnan(fidelity.jensen_shannon(a.withColumn("x", F.col("x") - 2), b, ["x"], ["id"]).first().score)
    assert math.isnan(fidelity.jensen_shannon(a.withColumn("x", F.lit(0)), b, ["x"], ["id"]).first().score)


def test_constant_columns_scale_by_one(spark):
    df = points(spark, np.array([[1.0, 5.0], [3.0, 5.0]]))
    assert sorted((r.a, r.b) for r in fidelity.standard_scale(df, df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_undefined_correlation_gap(spark):
    df = points(spark, np.array([[1.0, 5.0], [3.0, 5.0], [4.0, 5.0]]))
    assert fidelity.correlation_gap(df, df, ["a", "b"]).first().score is None
    assert fidelity.mixed_correlation_gap(df, df, {"a": "float", "b": "float"}).first().score == 0.0


def test_macro_f1_counts_unseen_classes(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "label double, prediction double")
    assert utility.f1_macro(pred).first().score == pytest.approx(1 / 3)
    assert utility.accuracy(pred).first().score == pytest.approx(2 / 3)
    assert utility.mse(pred).first().score == pytest.approx(1 / 3)


def regression_data(spark, n=300):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 2)) * [1, 3] + [2, -1]
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], "a double, b double, target double")
    return x, y, df


def test_ridge_and_lasso(spark):
    x, y, df = regression_data(spark)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    pred = utility.utility_regression(df, df, ["a", "b"], "Ridge").collect()
    want = {round(t, 9): p for t, p in zip(y, y.mean() + xc @ w)}
    assert all(r.prediction == pytest.approx(want[round(r.label, 9)], abs=1e-6) for r in pred)
    # Coordinate descent on 1/(2n) |y - Xw|^2 + |w|.
    w = np.zeros(2)
    for _ in range(500):
        for j in range(2):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 1, 0) / (xc[:, j] ** 2).mean()
    pred = utility.utility_regression(df, df, ["a", "b"], "Lasso").collect()
    want = {round(t, 9): p for t, p in zip(y, y.mean() + xc @ w)}
    assert all(r.prediction == pytest.approx(want[round(r.label, 9)], abs=1e-4) for r in pred)


def test_bayesian_ridge_settles_at_its_evidence(spark):
    x, y, df = regression_data(spark)
    weights, intercept = utility.bayesian_ridge(df, ["a", "b"], "target", tol=1e-10)
    assert weights == pytest.approx([3, -0.5], abs=0.1) and intercept == pytest.approx(0, abs=0.3)


def test_truncated_targets(spark):
    _, _, df = regression_data(spark)
    whole = df.withColumn("target", F.when(F.col("target") < 0, F.ceil("target")).otherwise(F.floor("target")).cast("double"))
    a = utility.mse(utility.utility_regression(df, df, ["a", "b"], "LinearRegression", truncate_target=True)).first().score
    b = utility.mse(utility.utility_regression(whole, df, ["a", "b"], "LinearRegression")).first().score
    assert a == pytest.approx(b)


@pytest.mark.parametrize("model", utility.CLASSIFIERS)
def test_classifiers_learn_separable_classes(spark, model):
    rng = np.random.default_rng(7)
    rows = [(float(rng.normal(4 * c)), float(rng.normal(-4 * c)), c) for c in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, target int").repartition(2).cache()
    assert utility.f1_macro(utility.utility_classification(df, df, ["a", "b"], model)).first().score > 0.9


def test_score_table_reports_errors_and_groups(spark):
    _, _, df = regression_data(spark)

    def broken(train, test, synthetic):
        raise ValueError("cannot score this")

    def fails_later(train, test, synthetic):
        return synthetic.agg(F.max(F.raise_error(F.lit("broken row"))).cast("double").alias("score"))

    metrics = [("LinearRegression-MSE", utility_metrics(["a", "b"], "regression")[0][1]), ("mine-Odd", broken), ("mine-Late", fails_later)]
    rows = score_table(with_control(df, df), df, df, metrics, repetition=2).collect()
    assert {(r.model, r.grp) for r in rows} == {(m, g) for m in ("synthetic", "GT") for g in ("MSE", "Odd", "Late")}
    for r in rows:
        assert r.repetition == 2
        assert (r.score, r.error) == (-1.0, "cannot score this") if r.grp == "Odd" else r.grp == "Late" or r.error is None
        assert r.grp != "Late" or (r.score == -1 and "broken row" in r.error)


def test_score_table_of_repetitions(spark):
    _, _, df = regression_data(spark)
    parts = df.withColumn("repetition", F.pmod(F.xxhash64("a"), F.lit(3)))
    metrics = [("LinearRegression-MSE", utility_metrics(["a", "b"], "regression")[0][1])]
    rows = score_table({"synthetic": parts, "GT": df}, df, df, metrics).collect()
    assert sorted((r.model, r.repetition) for r in rows) == [("GT", 0), ("synthetic", 0), ("synthetic", 1), ("synthetic", 2)]
    assert all(r.error is None and r.score > 0 for r in rows)


def test_regression_scores_are_those_of_the_models(spark):
    _, _, df = regression_data(spark)
    scaler = fidelity.fit_scaler(df, ["a", "b", "target"])
    train = df.withColumn("repetition", F.pmod(F.xxhash64("a"), F.lit(2)))
    got = {(r.repetition, r.model): r.score for r in utility.regression_scores(train, df, ["a", "b"], scaler=scaler, keys=["repetition"]).collect()}
    assert len(got) == 8
    for n in (0, 1):
        part = train.filter(F.col("repetition") == n)
        for model in utility.REGRESSORS:
            want = utility.mse(utility.utility_regression(part, df, ["a", "b"], model, scaler=scaler)).first().score
            assert got[n, model] == pytest.approx(want, rel=1e-5, abs=1e-8)
    with pytest.raises(ValueError, match="incomplete"):
        utility.regression_scores(df, df.unionAll(spark.createDataFrame([(None, 1.0, 1.0)], df.schema)), ["a", "b"])


def test_jobs_do_not_grow_with_repetitions(spark):
    """The closed-form metrics of many repetitions take as many jobs as those of one, with an error per empty one."""
    _, _, df = regression_data(spark)
    df = df.cache()
    chosen = [m for m in default_metrics(["a", "b", "target"], "regression") if not str(m[0]).startswith("privacy-DCR")]
    jobs = []
    for count in (2, 12):
        parts = df.withColumn("repetition", F.pmod(F.xxhash64("a"), F.lit(count)))
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"score-{count}", "")
        rows = score_table({"synthetic": parts}, df, df, chosen).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"score-{count}")))
        spark.sparkContext.setJobGroup("rest", "")
        assert len(rows) == 6 * count and all(r.error is None for r in rows)
    assert jobs[1] <= jobs[0] + 2
    hole = df.withColumn("repetition", F.lit(0)).unionAll(df.limit(3).withColumns({"a": F.lit(None).cast("double"), "repetition": F.lit(1)}))
    got = {(r.repetition, r.metric): (r.score, r.error) for r in score_table({"synthetic": hole}, df, df, chosen[:1]).collect()}
    assert got[1, "Ridge-MSE"] == (-1.0, "no complete rows") and got[0, "Ridge-MSE"][1] is None


def test_null_rows_do_not_bend_a_fit(spark):
    rows = [(float(x), 2.0 * x + 1) for x in range(50)] + [(None, 5.0), (7.0, None)]
    df = spark.createDataFrame(rows, "a double, target double")
    weights, intercept = utility.bayesian_ridge(df, ["a"], "target")
    assert weights[0] == pytest.approx(2, abs=1e-4) and intercept == pytest.approx(1, abs=1e-2)
    far = df.withColumns({"a": F.col("a") + 1e9, "target": F.col("target") + 1e9})
    assert utility.bayesian_ridge(far, ["a"], "target")[0][0] == pytest.approx(2, abs=1e-4)


def test_null_rows_are_an_error_for_classifiers(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1), (3.0, 1)], "a double, target int")
    with pytest.raises(Exception, match="(?i)null|nan|invalid"):
        utility.utility_classification(df, df, ["a"], "DecisionTreeClassifier").collect()


def test_default_metrics_by_task():
    names = metric_names(default_metrics(["a", "b", "target"], "classification"))
    assert len(names) == 14 and names[-1] == "privacy-Dub"
    assert metric_names(default_metrics(["a", "target"], "regression"))[:4] == [
        "LinearRegression-MSE", "Ridge-MSE", "Lasso-MSE", "BayesianRidge-MSE",
    ]


def test_training_tasks_follow_the_cores():
    assert [utility.training_tasks(n, 12) for n in (0, 1, 20_001, 10**5)] == [1, 1, 2, 5]
    assert utility.training_tasks(10**7, 12) == utility.training_tasks(10**9, 12) <= 4 * 12
