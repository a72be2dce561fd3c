from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.operators import association, dictionary, profile, quantiles, shifts


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*cols.values())]
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("kind", ["normal", "heavy", "hot", "two", "constant", "integers"])
@pytest.mark.parametrize("bracket_rows", [20, 400, 10**9])
def test_bracketed_percentiles_equal_numpy(spark, kind, bracket_rows):
    rng = np.random.default_rng(1)
    n = 4001
    x = {
        "normal": rng.normal(size=n),
        "heavy": rng.pareto(0.5, n),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, n)),
        "two": np.where(rng.random(n) < 0.3, 0.0, 1.0),
        "constant": np.full(n, 2.5),
        "integers": rng.integers(0, 9, n).astype(float),
    }[kind]
    df = frame(spark, x=x)
    row = quantiles.quantiles_by_brackets(df, ["x"], bracket_rows=bracket_rows).first()
    for name, p in quantiles.PERCENTILES.items():
        assert row[name] == pytest.approx(np.percentile(x, p * 100), rel=1e-12, abs=1e-12), name


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    """With brackets of no width most ranks are missed at first; the result stays exact."""
    monkeypatch.setattr(quantiles, "BRACKET_WIDTH", 0.0)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", 60)
    x = np.random.default_rng(2).normal(size=3000)
    row = quantiles.quantiles_by_brackets(frame(spark, x=x), ["x"], bracket_rows=50).first()
    assert row["p50"] == pytest.approx(np.percentile(x, 50), rel=1e-12)
    assert row["p99"] == pytest.approx(np.percentile(x, 99), rel=1e-12)


def test_percentiles_per_key_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    key, x = np.where(rng.random(3000) < 0.7, "hot", "cold"), rng.exponential(size=3000)
    df = frame(spark, key=key, x=x)
    rows = quantiles.quantiles_by_parts(df, ["x"], ["key"], rows_per_part=200).collect()
    assert {r.key for r in rows} == {"hot", "cold"}
    for r in rows:
        assert r.p25 == pytest.approx(np.percentile(x[key == r.key], 25), rel=1e-12)


def test_nulls_are_not_counted(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, None)], "a double, b double")
    rows = {r.column: r for r in profile.numeric_profile(df, ["a", "b"]).collect()}
    assert rows["a"].n == 3 and rows["b"].n == 1 and rows["b"].p50 == 5.0


def test_skew_and_kurtosis_are_the_biased_ones(spark):
    x = np.random.default_rng(4).gamma(2, size=500)
    row = profile.numeric_profile(frame(spark, x=x), ["x"]).first()
    z = (x - x.mean()) / x.std()
    assert row["skew"] == pytest.approx((z**3).mean()) and row["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert row["std"] == pytest.approx(x.std())


@pytest.mark.parametrize("rows_per_part", [None, 100])
def test_planted_distributions(spark, rows_per_part):
    rng = np.random.default_rng(5)
    df = frame(
        spark, norm=rng.normal(10, 2, 1500), expon=rng.exponential(3, 1500), uniform=rng.uniform(-1, 4, 1500),
        constant=np.full(1500, 1.0),
    )
    found = {r.column: r for r in profile.fit_distribution(df, df.columns, rows_per_part=rows_per_part).collect()}
    assert all(found[c].distribution == c for c in ("norm", "expon", "uniform"))
    assert found["constant"].distribution is None
    assert found["expon"].scale == pytest.approx(3, rel=0.1) and found["norm"]["loc"] == pytest.approx(10, rel=0.05)


def test_modes(spark):
    rng = np.random.default_rng(6)
    two = np.concatenate([rng.normal(-1000, 1, 1500), rng.normal(1000, 2, 500)])
    df = frame(spark, two=two, one=rng.normal(1e6, 1, 2000), constant=np.full(2000, 3.0))
    modes = profile.fit_modes(df, df.columns).orderBy("column", "mode").collect()
    pair = [m for m in modes if m.column == "two"]
    assert [round(m["mean"]) for m in pair] == [-1000, 1000]
    assert [round(m.weight, 2) for m in pair] == [0.75, 0.25]
    assert pair[1]["std"] == pytest.approx(2, rel=0.2)
    single = [m for m in modes if m.column == "one"]
    assert len(single) == 1 and single[0]["mean"] == pytest.approx(1e6, abs=0.2) and single[0]["std"] == pytest.approx(1, rel=0.1)
    assert len([m for m in modes if m.column == "constant"]) == 1


def chi_square_v(a, b):
    xs, ys = sorted(set(a)), sorted(set(b))
    obs = np.array([[sum(p == x and q == y for p, q in zip(a, b)) for y in ys] for x in xs], float)
    e = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    gap = np.abs(obs - e)
    if obs.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return np.sqrt((gap**2 / e).sum() / (obs.sum() * (min(obs.shape) - 1)))


def test_cramers_v(spark):
    rng = np.random.default_rng(7)
    a = rng.choice(list("xyz"), 300)
    b = np.where(a == "x", "p", rng.choice(list("pq"), 300))
    c, one = rng.choice(list("mn"), 300), np.full(300, "k")
    df = frame(spark, a=a, b=b, c=c, one=one)
    got = {(r.column, r.other): r.value for r in association.cramers_v_matrix(df, df.columns, diagonal=True).collect()}
    for x, y in [("a", "b"), ("b", "c"), ("a", "c"), ("b", "b"), ("a", "a")]:
        data = {"a": a, "b": b, "c": c}
        assert got[x, y] == pytest.approx(chi_square_v(data[x], data[y]), abs=1e-9), (x, y)
    assert got["a", "b"] == got["b", "a"] and got["a", "one"] is None
    assert all(v is None or 0 <= v <= 1 for v in got.values())


def test_eta_and_pearson_of_a_constant_are_undefined(spark):
    df = frame(spark, g=np.array(["a", "b", "a"]), x=np.array([1.0, 2.0, 3.0]), k=np.array([4.0, 4.0, 4.0]))
    eta = {(r.column, r.other): r.value for r in association.eta_matrix(df, ["g"], ["x", "k"]).collect()}
    assert eta["g", "k"] is None and eta["g", "x"] == pytest.approx(0.0)
    assert all(r.value is None for r in association.pearson_matrix(df, ["x", "k"]).collect())


def test_wide_pearson_equals_pairwise(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(200, 42)) + rng.normal(size=(200, 1))
    df = frame(spark, **{f"c{i}": data[:, i] for i in range(42)})
    corr = np.corrcoef(data.T)
    rows = association.pearson_matrix(df, df.columns).collect()
    assert len(rows) == 42 * 41
    assert all(r.value == pytest.approx(corr[int(r.column[1:]), int(r.other[1:])], abs=1e-9) for r in rows)


def test_pseudo_r2(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-2 * x))).astype(int)
    # Newton's method for the two-parameter logit.
    w, z = np.zeros(2), np.column_stack([np.ones(800), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    p = 1 / (1 + np.exp(-z @ w))
    ll = np.log(np.where(y == 1, p, 1 - p)).sum()
    share = y.mean()
    want = 1 - ll / (800 * (share * np.log(share) + (1 - share) * np.log(1 - share)))
    got = association.pseudo_r2(frame(spark, c=np.where(y == 1, "yes", "no"), x=x), "c", "x").first()
    assert got.value == pytest.approx(want, rel=1e-5)


def test_first_seen_codes_and_round_trip(spark):
    df = spark.createDataFrame([(3, "b", 1.9), (1, "c", 2.9), (2, "b", -3.9), (4, "a", 4.0)], "id bigint, s string, x double")
    for parts in (None, 1):
        labels = dictionary.fit_dictionary(df, ["s"], "id", parts)
        assert {r.value: r.code for r in labels.collect()} == {"c": 0, "b": 1, "a": 2}
    roles = {"s": "str", "x": "int"}
    coded = dictionary.encode(df, labels, roles)
    assert {r.id: (r.s, r.x) for r in coded.collect()} == {1: (0, 2), 2: (1, -3), 3: (1, 1), 4: (2, 4)}
    back = dictionary.decode(coded, labels, roles)
    assert {r.id: r.s for r in back.collect()} == {1: "c", 2: "b", 3: "b", 4: "a"}


def test_empty_half_and_absent_cells_have_shifts(spark):
    """All numbers equal their median: nothing is small, and that half is reported as minus the base share."""
    df = frame(spark, g=np.array(["a", "a", "b"]), h=np.array(["x", "x", "y"]), v=np.array([1.0, 1.0, 1.0]))
    roles = {"g": "str", "h": "str", "v": "float"}
    edges = spark.createDataFrame([("g", "v"), ("g", "h")], "column string, other string")
    halves = {(r.condition, r.value): r["shift"] for r in shifts.cat_given_cont(df, edges, roles).collect()}
    assert halves == {("big", "a"): 0.0, ("big", "b"): 0.0, ("small", "a"): -0.667, ("small", "b"): -0.333}
    cells = {(r.condition, r.value): r["shift"] for r in shifts.cat_given_cat(df, edges, roles).collect()}
    assert cells == {("x", "a"): 0.333, ("x", "b"): -0.333, ("y", "a"): -0.667, ("y", "b"): 0.667}


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0), ("a", 3.0, 5.0)], ["Cloud Cover", "Rain (%)", "x.y_int"])
    roles = {"Cloud Cover": "str", "Rain (%)": "float", "x.y_int": "float"}
    assert association.mixed_matrix(df, roles).count() == 6
    assert profile.numeric_profile(df, ["Rain (%)", "x.y_int"]).count() == 2
    assert profile.fit_modes(df, ["Rain (%)", "x.y_int"]).count() >= 2
    assert {r.column for r in profile.category_profile(df, ["Cloud Cover"]).collect()} == {"Cloud Cover"}


@pytest.mark.parametrize("rows_per_part", [None, 20])
def test_nan_is_missing(spark, rows_per_part):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),)] * 9, "x double")
    row = profile.numeric_profile(df, ["x"], rows_per_part=rows_per_part).first()
    assert row.n == 100 and row["max"] == 99.0 and row.p50 == 49.5


def test_a_large_table_is_spread_before_it_is_profiled(spark, monkeypatch):
    """A file of one row group comes as one task; the passes of a profile have more."""
    from tabweave.functions import ordering
    from tabweave.plans import profiling

    df = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("c"), (F.col("id") * 1.5).alias("x")).coalesce(1)
    small = profiling.profile_table(df, {"c": "str", "x": "float"}, "id", fast=True)
    seen, whole = [], profiling.profile.numeric_profile
    monkeypatch.setattr(profiling.profile, "numeric_profile", lambda given, cols: seen.append(given.rdd.getNumPartitions()) or whole(given, cols))
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 100)
    large = profiling.profile_table(df, {"c": "str", "x": "float"}, "id", fast=True)
    assert seen[0] > 1
    assert sorted(map(tuple, large.dictionary.collect())) == sorted(map(tuple, small.dictionary.collect()))
    a, b = (list(p.numeric.first()) for p in (large, small))
    assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_distances_of_large_columns_need_few_values(spark):
    """Only values near the greatest gaps are counted; distances are those of all values."""
    draw = np.random.default_rng(4)
    data = {
        "wave": draw.normal(3, 2, 20_000), "tail": draw.pareto(0.7, 20_000), "flat": draw.random(20_000), "few": draw.integers(0, 9, 20_000) * 1.0,
        "same": np.full(20_000, 2.5), "heavy": np.where(draw.random(20_000) < 0.9, 0.0, draw.normal(0, 1, 20_000)), "steps": np.round(draw.normal(0, 1, 20_000), 2),
    }
    rows = pd.DataFrame(data)
    rows.loc[::7, "wave"], rows.loc[::5, "few"] = np.nan, np.nan
    df = spark.createDataFrame(rows).withColumn("none", F.lit(None).cast("double")).repartition(3)
    numeric = profile.numeric_profile(df, df.columns).localCheckpoint()
    got, want = ({r.column: r for r in profile.fit_distribution(df, df.columns, rows_per_part=n, profile=numeric).collect()} for n in (10_000, None))
    assert got == want and set(got) == set(data) and got["same"].distribution is None
    values = profile._decisive_values(df.select("wave", "tail"), ["wave", "tail"], numeric, 10_000)
    assert values.count() < 8_000
    # A cell with too many rows is left to the ranks of all values.
    assert profile._decisive_values(df, df.columns, numeric, 1) is None
    assert {r.column: r for r in profile.fit_distribution(df, df.columns, rows_per_part=1_000, profile=numeric).collect()} == want
