from __future__ import annotations

import numpy as np
import pytest

from tabweave.llm import embeddings as em


def brute(ids, vectors, least=0.95):
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], max(ids)).min(axis=1))
        if (new == root).all():
            break
        root = new
    return {i: (int(n), int(r), i == r) for i, n, r in zip(ids, near.sum(axis=1), root)}


def clustered(draw, n, dims=12, centres=9, noise=0.06):
    middle = draw.normal(size=(centres, dims))
    which = np.minimum(draw.integers(0, centres * 2, n), centres - 1)
    return middle[which] + draw.normal(size=(n, dims)) * noise * draw.choice([0.2, 1, 3], size=(n, 1))


@pytest.mark.parametrize("cell_rows", [15, 60, 4096])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, cell_rows, kind):
    draw = np.random.default_rng(cell_rows)
    vectors = clustered(draw, 400).astype("float32" if kind == "float" else "float64").astype(float)
    vectors[200:240] = vectors[3]  # copies
    ids = draw.permutation(1000)[:400].tolist()
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in zip(ids, vectors)], f"vec_id bigint, embedding array<{kind}>, cell string, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.embedding_components(df.repartition(5), cell_rows=cell_rows).collect()}
    want = brute(ids, vectors)
    assert got == want and max(n for n, _, _ in want.values()) > 100


def test_chains_cross_cells(spark):
    turns = np.arange(60) * np.arccos(0.951)
    vectors = [[float(np.cos(t)), float(np.sin(t)), 0.0] for t in turns[:12]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in em.embedding_components(df, cell_rows=2).collect()}
    assert got == {i: (1 if i in (0, 11) else 2, 0) for i in range(12)}


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (10, [1e300, 1e300]), (11, [-1.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in em.embedding_components(df).collect())
    assert got == [
        (-1, 0, None, True), *[(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)], (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False),
        (9, 0, 9, True), (10, 3, 7, False), (11, 0, 11, True),
    ]
    assert em.embedding_components(df.limit(0)).count() == 0
    assert em.embedding_components(df.filter("vec_id < 7")).filter("kept").count() == 6


def test_the_limit_is_exact():
    a = em.unit_rows(np.array([[1.0, 0.0]]))
    for cosine, is_linked in ((0.95, True), (0.9499999999999, False), (0.9500000000001, True)):
        b = np.array([[cosine, np.sqrt(1 - cosine**2)]])
        assert em.linked(a, b, 0.95)[0, 0] == is_linked


def test_float_vectors_next_to_the_limit(spark):
    draw = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(draw.normal(size=(20_000, 64)))
    aside = draw.normal(size=one.shape)
    aside = unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    one, two = (x.astype("float32").astype(float) for x in (one, 0.95 * one + np.sqrt(1 - 0.95**2) * aside))
    off = (unit(one) * unit(two)).sum(axis=1) - 0.95
    planted = np.concatenate([np.flatnonzero(side & (np.abs(off) < 1e-8) & (np.abs(off) > 1e-13))[:150] for side in (off < 0, off > 0)])
    vectors = np.concatenate((one[planted], two[planted]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in em.embedding_components(df, cell_rows=60).collect()}
    assert got == brute(list(range(300 * 2)), vectors) and sum(n for n, _, _ in got.values()) == 300


def test_query(spark):
    from tabweave.llm.queries import op1_embedding_components

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op1_embedding_components(spark, sf).collect()} == want
