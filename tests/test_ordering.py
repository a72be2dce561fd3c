from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions.lookup import lookup
from tabweave.functions.numeric import norm_cdf, plain_number, rounded
from tabweave.functions.ordering import INLINE_CUTS, global_rank, hash_rank, part_count, part_of
from tabweave.functions.seeded import seeded_hash, standard_normal, unit


@pytest.mark.parametrize("n", [1, 2, 7, INLINE_CUTS, INLINE_CUTS + 1, 1000])
def test_part_of_counts_the_cuts_below(spark, n):
    cuts = [i * 3 for i in range(n)]
    rows = spark.range(-5, 3 * n + 5).select("id", part_of(F.col("id"), [F.lit(c).cast("bigint") for c in cuts]).alias("p"))
    assert all(r.p == sum(c <= r.id for c in cuts) for r in rows.collect())


def test_global_rank_with_a_hot_leading_column(spark):
    """A third of the rows share the leading key; ranks are those of a plain sort all the same."""
    data = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("int").alias("k")
    )
    got = [(r.k, r.id) for r in global_rank(data, ["k", "id"], "rank", "rows", rows_per_part=100).orderBy("rank").collect()]
    want = sorted((7 if i % 3 == 0 else i % 50, i) for i in range(3000))
    assert got == want


def test_rank_does_not_depend_on_parts(spark):
    data = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    a = hash_rank(data, ["g"], seeded_hash(1, "id"), ["id"], "rank", "rows")
    b = hash_rank(data.repartition(5), ["g"], seeded_hash(1, "id"), ["id"], "rank", "rows", rows_per_part=50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert {r.rows for r in a.collect()} == {700, 300}


def test_unit_is_uniform_and_normal_is_normal(spark):
    row = spark.range(20000).select(unit(3, "id").alias("u"), standard_normal(3, "id").alias("z")).agg(
        F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")
    ).first()
    assert abs(row[0] - 0.5) < 0.01 and row[1] >= 0 and row[2] < 1
    assert abs(row[3]) < 0.03 and abs(row[4] - 1) < 0.03


def test_norm_cdf(spark):
    z = [float(v) for v in np.linspace(-9, 9, 400)] + [-40.0, 40.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", norm_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-7, abs=1e-13)


def test_rounded_has_no_negative_zero(spark):
    value = spark.range(1).select(rounded(F.lit(-0.001), 2).alias("v")).first().v
    assert value == 0 and math.copysign(1, value) == 1


def test_plain_number(spark):
    values = [0.0, 12.5, 1e7, 123456789.25, 1e-5, -3e8, 1e20]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", plain_number(F.col("v")).alias("t")).collect()
    assert all("E" not in r.t and float(r.t) == r.v for r in rows)


@pytest.mark.parametrize("size", [10, 10**9])
def test_lookup_small_and_large_dictionaries(spark, size):
    """A claimed large size takes the hot-and-rest path; the result is the same, misses stay null."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("c"))
    counts = df.groupBy(F.col("c").alias("value")).agg(F.count("*").alias("n"))
    entries = counts.filter("value <> 'v1'").withColumn("code", F.length("value"))
    got = lookup(df, "c", entries, "value", "code", "c", size, "n")
    assert got.columns == ["id", "c"] and got.count() == 2000
    for r in got.collect():
        assert r.c == (None if r.id == 1 else 3 if r.id % 2 == 0 else len(f"v{r.id}"))


@pytest.mark.parametrize("ends", [[10], [0, 10], [250, 700, 1000], [999, 1000, 5000], [500, 500]])
def test_rank_intervals_by_boundaries(spark, ends):
    """Ranked or compared with looked-up boundaries: the same intervals, also with ties in the leading column."""
    from tabweave.operators.prepare import rank_intervals

    data = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    for options in ({"key": ["id"]}, {"order": ["k", "id"]}, {"order": ["id"]}):
        a = {r.id: r.interval for r in rank_intervals(data, ends, **options).collect()}
        b = {r.id: r.interval for r in rank_intervals(data, ends, rows_per_part=50, **options).collect()}
        assert a == b and len(a) == 1000
        low = [min(e, 1000) for e in ends]
        assert [sum(v > i for v in a.values()) for i in range(len(ends))] == [1000 - e for e in low]


@pytest.mark.parametrize("ends", [[10], [120, 250], [799, 800, 801], [960, 1000]])
def test_rank_intervals_with_nulls_and_a_hot_lead(spark, ends):
    """Nulls first and NaN last on both paths; one value leads nine tenths of the numbers."""
    from tabweave.operators.prepare import rank_intervals

    kind = F.when(F.col("id") % 8 == 0, None).when(F.col("id") % 25 == 1, float("nan")).when(F.col("id") % 10 == 3, -1.5).otherwise(2.0)
    data = spark.range(1000).select("id", kind.cast("double").alias("k"))
    a = {r.id: r.interval for r in rank_intervals(data, ends, order=["k", "id"]).collect()}
    b = {r.id: r.interval for r in rank_intervals(data, ends, order=["k", "id"], rows_per_part=50).collect()}
    assert a == b and [sum(v > i for v in a.values()) for i in range(len(ends))] == [1000 - e for e in ends]


def test_large_dictionaries_read_the_table_once(spark, tmp_path):
    from tabweave.operators.dictionary import encode

    path = str(tmp_path / "rows")
    spark.range(100).select(*[(F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(4)]).write.parquet(path)
    df = spark.read.parquet(path)
    rows = [(f"c{i}", str(v), v, 50) for i in range(4) for v in range(i + 2)]
    entries = spark.createDataFrame(rows, "column string, value string, code bigint, n bigint")
    coded = encode(df, entries, {f"c{i}": "str" for i in range(4)}, sizes={f"c{i}": 10**9 for i in range(4)})
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    assert coded.filter("c3 IS NULL").count() == 0 and coded.count() == 100


def test_long_texts_with_a_common_start(spark):
    """Cut points are starts of texts; texts that share them are ranked all the same."""
    data = spark.range(600).select("id", F.concat(F.repeat(F.lit("x"), 100), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t"))
    ranked = global_rank(data, ["t"], "rank", rows_per_part=50)
    assert all(r.rank == r.id + 1 for r in ranked.collect())
    short = spark.range(600).select("id", F.lpad(F.col("id").cast("string"), 4, "0").alias("t"))
    assert all(r.rank == r.id + 1 for r in global_rank(short, ["t"], "rank", rows_per_part=50).collect())


def test_small_parts_do_not_become_tasks_without_end():
    assert [part_count(n, 10) for n in (0, 10, 95, 60_000, 10**9)] == [1, 1, 10, 64, 500]
    assert part_count(10**9) == 500 and part_count(10**9, 10**9) == 1
