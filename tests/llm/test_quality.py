from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm import quality as ql

SF = "/root/testdata/sf0.01"


def test_accuracies_are_recovered():
    draw = np.random.default_rng(1)
    n, right = 30_000, [0.95, 0.9, 0.85, 0.7, 0.8, 0.9, 0.75, 0.6, 0.9, 0.85]
    good = draw.random(n) < 0.8
    votes = np.stack([np.where(draw.random(n) < r, good, ~good).astype(int) for r in right], axis=1)
    votes[draw.random(votes.shape) < 0.2] = 2
    keys = ["".join(map(str, v)) for v in votes.tolist()]
    posteriors, table, prior = ql.fit_labellers(dict(Counter(keys)))
    assert prior == pytest.approx(0.8, abs=0.02)
    assert table[1, :, 1] == pytest.approx(right, abs=0.04) and table[0, :, 0] == pytest.approx(right, abs=0.06)
    assert np.mean([(posteriors[k] > 0.5) == g for k, g in zip(keys, good)]) > 0.97


def test_votes():
    texts = pa.array([
        "The cat sat on the mat and looked at the dog. It was a warm day in the garden.", "SHOUT!! NOW!! BUY!! THIS!! HERE!! TODAY!!",
        "a### b*** c%%% d&&& e$$$ f###", "x\n" * 30, "one | two | three | four | five | six", "word " * 50, "", None, "Short.",
    ])
    votes, features = ql.ChunkTraits().judge(texts)
    by_name = [dict(zip(ql.LABELLERS, v)) for v in votes.tolist()]
    assert 0 not in by_name[0].values() and by_name[1]["capitals"] == 0 and by_name[1]["shouts"] == 0
    assert by_name[2]["symbols"] == 0 and by_name[3]["repeats"] == 0 and by_name[4]["separators"] == 0 and by_name[5]["stutter"] == 0
    assert set(by_name[6].values()) == set(by_name[7].values()) == set(by_name[8].values()) == {2}
    assert features.shape == (9, ql.BUCKETS + 3) and not features[6].any()


def test_scores_follow_the_labels(spark):
    from tabweave.llm.queries import op8_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(k == bool(q) for k, q in known) / len(known) >= 0.96
    good = [k for k, q in known if q]
    assert sum(good) / len(good) >= 0.99


def test_odd_tables(spark):
    kinds = "doc_id bigint, text string, _row int, prediction string"
    rows = [(1, None, 1, "a"), (1, None, 1, "a"), (2, "", 2, "b"), (None, "The cat sat on the mat and was happy.", 3, None)]
    df = spark.createDataFrame(rows, kinds)
    kept = ql.drop_poor(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert ql.score_quality(df).count() == 4 and ql.score_quality(df.limit(0)).count() == 0 and ql.drop_poor(df.limit(0)).count() == 0


def test_poor_documents_go(spark):
    good = [(i, "The cat sat on the mat and looked at the dog. It was a warm day in the garden of the house.") for i in range(60)]
    poor = [(100 + i, "BUY!! THIS!! NOW!! AND!! SAVE!! MONEY!! TODAY!! HERE!! OK!!") for i in range(12)]
    kept = ql.drop_poor(spark.createDataFrame(good + poor, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in good]


def test_shapes_are_those_of_whole_chunks():
    from tabweave.llm.quality import shape

    assert shape("a" * 100) != shape("a" * 100 + "%$" * 5) and shape("Ab" * 50 + "7") == "Xx" * 50 + "9"
