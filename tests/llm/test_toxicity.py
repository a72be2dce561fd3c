from __future__ import annotations

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    from tabweave.llm.queries import op7_toxicity

    return {r.doc_id: r for r in op7_toxicity(spark, SF).collect()}


def test_held_out_documents(spark, scored):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for doc, r in scored.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[d]) for d, r in scored.items() if r.held_out and d in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.9
    assert not any(p and not y for p, y in held)


def test_labels_of_the_held_out_fold_are_not_read(spark, scored):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(tx.fold_of("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in tx.score_toxicity(docs, turned).collect()}
    assert again == {d: r.score for d, r in scored.items()}


def test_features():
    table = tx.ChunkTable({"fiend": 2.0, "grum-": 1.0})
    names = [*tx.CHUNK_FEATURES, "n_strong", "n_hits", "near_you", "distinct"]
    rows = [dict(zip(names, r)) for r in table.matrix(pa.array(["You are a FIEND!!", "f1end grumbles b.a.d sooo", "plain words", "", None, " \n "]))]
    assert rows[0]["strong"] == 0.25 and rows[0]["you"] == 0.25 and rows[0]["near_you"] > 0 and rows[0]["shouts"] == 0.5
    assert rows[1]["hidden"] == 0.25 and rows[1]["weak"] == 0.25 and rows[1]["inner"] == 0.25 and rows[1]["stretched"] == 0.25
    assert rows[2]["strong"] == rows[2]["near_you"] == 0 and all(not any(r.values()) for r in rows[3:])


def test_near_words_stay_in_their_text():
    table = tx.ChunkTable({"fiend": 2.0})
    rows = table.matrix(pa.array(["fiend", "you"]))
    assert rows[0, -2] == 0 and rows[1, -2] == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "p", 1.0), (2, None, "q", 2.0), (2, None, "q", 2.0), (None, "", "r", 3.0)], "doc_id bigint, text string, probability string, _score double")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in tx.score_toxicity(docs, none).collect()] == [0.0] * 4
    kept = tx.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    rows = [(i, ("you vile wretch " if i % 2 else "a fine day ") * (1 + i % 3), "p", 0.0) for i in range(400)]
    many = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    kept = tx.drop_toxic(many, labels)
    assert kept.columns == docs.columns
    assert kept.filter("text LIKE '%wretch%'").count() == 0 and kept.filter("text LIKE 'a fine%'").count() == 200
    assert tx.score_toxicity(docs.limit(0), labels).count() == 0
