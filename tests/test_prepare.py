from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tabweave import roles
from tabweave.operators import prepare
from tabweave.sources import read_table


def test_recode_numbers_and_misses(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 4.0), (7, 2.5)], "a bigint, b double")
    a = [r.a for r in prepare.recode(df, "a", {0: "No", 1: "Yes"}).collect()]
    b = [r.b for r in prepare.recode(df, "b", {0.0: "A", 4.0: "F"}).collect()]
    assert a == ["No", "Yes", None] and b == ["A", "F", None]
    assert prepare.recode(df, "a", {}).first().a is None


def test_split_code_with_missing_pieces(spark):
    df = spark.createDataFrame([("AA-123",), ("B",), (None,)], "flight string")
    rows = prepare.split_code(df, "flight", "-", ["prefix", "number"]).collect()
    assert [(r.prefix, r.number) for r in rows] == [("AA", "123"), ("B", None), (None, None)]


def test_incomplete_rows_and_null_counts(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None), (None, None)], "a int, `b c` string")
    assert prepare.drop_incomplete(df).count() == 1
    assert {r.column: r.nulls for r in prepare.null_counts(df).collect()} == {"a": 2, "b c": 2}


def test_sizes_are_capped(spark):
    split = prepare.train_test_split(spark.range(10), 100, 100, key=["id"])
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 7, "test": 2}
    few = prepare.train_test_split(spark.range(10), 3, 1, order=["id"])
    assert {r.id: r.split for r in few.collect()} == {0: "train", 1: "train", 2: "train", 3: "test"}
    with pytest.raises(ValueError):
        prepare.train_test_split(spark.range(10), 3, 1)


def test_slices_discard_the_tail(spark):
    out = prepare.repetition_slices(spark.range(10), 3, 2, ["id"])
    assert {r.id: r.repetition for r in out.collect()} == {i: i // 3 for i in range(6)}


def test_shuffle_is_stable_and_complete(spark):
    a = [r.id for r in prepare.shuffle(spark.range(100), ["id"]).collect()]
    b = [r.id for r in prepare.shuffle(spark.range(100).repartition(7), ["id"]).collect()]
    assert a == b and sorted(a) == list(range(100)) and a != sorted(a)


def test_casts(spark):
    df = spark.createDataFrame([("3.9", "x", "-2.5"), ("abc", "y", "1e3")], "i string, s string, f string")
    rows = prepare.cast_roles(df, {"i": "int", "s": "str", "f": "float"}).collect()
    assert [tuple(r) for r in rows] == [(3, "x", -2.5), (None, "y", 1000.0)]
    big = spark.range(2**53 + 1, 2**53 + 2).withColumnRenamed("id", "i")
    assert prepare.cast_roles(big, {"i": "int"}).first().i == 2**53 + 1
    with pytest.raises(ValueError, match="unknown roles"):
        prepare.cast_roles(df, {"i": "date"})


def test_inferred_roles_leave_out_dates(spark):
    df = spark.createDataFrame([(1, 2.0, "x", datetime.date(2024, 1, 1))], "a int, b double, c string, d date")
    df = df.withColumn("e", F.lit(1).cast("decimal(10,2)"))
    assert roles.infer_roles(df) == {"a": "int", "b": "float", "c": "str", "e": "float"}


def test_csv_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('id,"name, full",x\n1,"a ""b""\nc",2.5\n2,,3\n')
    rows = read_table(spark, path, "csv", multiline=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b"\nc', 2.5), (2, None, 3.0)]
    with pytest.raises(ValueError):
        read_table(spark, path, "orc")


@pytest.mark.parametrize("by", [{"key": ["id"]}, {"order": ["lead", "id"]}])
def test_parts_of_a_large_split_hash_no_row_again(spark, by):
    df = spark.range(400).select("id", F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint").alias("lead"))
    cut = prepare.train_test_split(df, 10**9, 10**9, **by, rows_per_part=50)
    whole = {(r.id, r.split) for r in prepare.train_test_split(df, 10**9, 10**9, **by).collect()}
    assert {(r.id, r.split) for r in cut.collect()} == whole and len(whole) == 400
    for part in ("train", "test"):
        plan = cut.filter(F.col("split") == part).drop("split")._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan


def test_a_large_split_is_spread(spark):
    """A file of one row group comes as one task; what reads the split has more."""
    df = spark.range(3_000).withColumn("x", F.col("id") * 2).coalesce(1)
    cut = prepare.train_test_split(df, 10**9, 10**9, key=["id"], rows_per_part=500)
    sizes = [r["n"] for r in cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and sum(sizes) == 3_000
    whole = prepare.train_test_split(df, 10**9, 10**9, key=["id"])
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("keys", [range(4_000), [i // 2 for i in range(4_000)], [None if i % 2 else i for i in range(4_000)]])
def test_a_small_split_of_a_large_table_leaves_the_rest(spark, monkeypatch, keys):
    """Few of many rows are looked up among the lowest hashes, equal and missing keys included."""
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "id bigint, x bigint")
    sizes = []
    monkeypatch.setattr(prepare, "durable", lambda d: (kept := d.localCheckpoint(), sizes.append(kept.count()))[0])
    by = {"key": ["id", "x"]} if len(set(keys)) == 4_000 else {"key": ["id"]}
    cut = prepare.train_test_split(df, 150, 50, **by, rows_per_part=500)
    whole = prepare.train_test_split(df, 150, 50, **by)
    places = lambda d: sorted((str(r.id), r.split) for r in d.collect())
    assert places(cut) == places(whole) and len(places(cut)) == 200
    if len(set(keys)) == 4_000:
        assert max(sizes) < 1_000
