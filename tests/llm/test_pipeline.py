from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from tabweave.llm.packing import token_count

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from tabweave.llm.common import saved

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        docs = saved(out[-1][1], "stage")
        out[-1] = (out[-1][0], docs)
    return out


def test_stages_keep_whole_rows(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() < before.count()
        assert after.exceptAll(before).count() == 0


def test_decisions_follow_the_labels(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (given, calm), (_, fine) = stages[0], stages[1]
    gone = given.join(calm, "doc_id", "left_anti").join(labels, "doc_id").groupBy("toxic").count().collect()
    assert {r.toxic for r in gone} == {1}
    gone = calm.join(fine, "doc_id", "left_anti").join(labels, "doc_id").groupBy("quality").count().collect()
    counts = defaultdict(int, {r.quality: r["count"] for r in gone})
    assert counts[0] > 20 * counts[1]


def test_one_document_of_each_group_stays(spark, stages):
    from tests.llm.test_near_documents import brute

    before, after = stages[2]
    groups = brute([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))


def test_packing_holds_all_that_is_left(stages):
    before, packed = stages[3]
    want = {r[0]: r[1] for r in before.select("doc_id", token_count(before.text)).collect()}
    got = defaultdict(int)
    for r in packed.collect():
        got[r.doc_id] += r.n_tokens
    assert got == want


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    assert corpus_pipeline.ORACLE_SQL is None
    calls = []

    def stage(name, limit):
        def apply(spark, docs, sf_dir):
            calls.append((name, docs.count(), sf_dir))
            return docs.filter(f"doc_id < {limit}")

        return name, apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a", 100), stage("b", 50), stage("c", 20)])
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() == 20
    assert calls == [("a", 200, sf), ("b", 100, sf), ("c", 50, sf)]


def test_workers_hold_little_of_many_texts():
    import tracemalloc

    import pandas as pd

    from tabweave.llm.near_documents import _signed

    texts = [" ".join(f"w{(n * 7 + i * i) % 5_000}" for i in range(2_000)) for n in range(400)]
    rows = pd.DataFrame({"id": range(400), "text": texts})
    tracemalloc.start()
    assert sum(map(len, _signed(iter([rows])))) == 400
    signing = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert signing < 40_000_000
