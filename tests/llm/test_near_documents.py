from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import near_documents as nd
from tabweave.llm.common import WordHashes, components, mix


def word(chunk):
    inside = [i for i, c in enumerate(chunk) if unicodedata.category(c)[0] in "LMN"]
    return chunk[inside[0] : inside[-1] + 1] if inside else chunk


def counter(text):
    words = [word(x.lower()) for x in (text or "").split()]
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute(rows, least=0.8):
    sets = [counter(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            # Texts without words are copies of equal ones only.
            if rows[i][1] == rows[j][1] if not sets[i] or not sets[j] else jaccard(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return {doc: smallest[find(i)] for i, (doc, _) in enumerate(rows)}


def corpus(seed, bases=25, copies=6):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=4)) for _ in range(3000)]
    rows = []
    for _ in range(bases):
        base = draw.choices(words, k=draw.choice([3, 6, 30, 120, 300]))
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5, 20])):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows) * 17 % 997, draw.choice([" ", "  ", "\n"]).join(text) + draw.choice(["", ".", " !"])))
    return rows + [(990, None), (991, ""), (992, " .. "), (993, "repeat this line now\n" * 300), (994, "repeat this line now\n" * 290)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, node int, id int").repartition(4)
    got = nd.near_documents(df).collect()
    assert {r.doc_id: r.group_id for r in got} == brute(rows) and len(got) == len(rows)
    for r in got:
        assert r.kept == (r.doc_id == r.group_id) and r.group_id <= r.class_id <= r.doc_id


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(4)
    base = ["w%d" % draw.randrange(10_000) for _ in range(150)]
    rows = []
    for i in range(500):
        text = list(base)
        for _ in range(draw.choice([0, 1, 2])):
            text[draw.randrange(150)] = f"x{draw.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    got = nd.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r.group_id == 0 for r in got) >= 495
    assert {r.doc_id: r.group_id for r in got} == brute(rows)


def test_different_texts_without_letters_stay_apart(spark):
    texts = ["😀 😀", "🙃", "+ + =", "C++ is 3.14", "C is 314", "की", "का", None, "", "  ", "की", None, "C++ is 3.14."]
    got = {r.doc_id: r.group_id for r in nd.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {**{i: i for i in range(10)}, 10: 5, 11: 7, 12: 3}


def test_agreement_is_the_weighted_similarity():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        hashes = np.unique(mix(np.arange(1, 60, dtype=np.uint64) + np.uint64(draw.integers(1 << 60))))
        a = draw.integers(1, 40, len(hashes))
        b = np.where(draw.random(len(hashes)) < 0.7, a, draw.integers(1, 40, len(hashes)))
        one, other = nd.signatures([(hashes, a), (hashes[5:], b[5:])])
        errors.append((one == other).mean() - nd.overlap((hashes, a), (hashes[5:], b[5:])))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_overlap_counts_repeats():
    memo = WordHashes()
    for a, b in [("a b c d e f", "a b c d e f a b c d e"), ("x y", "x y"), ("x y", "y x"), ("", "  ")]:
        assert nd.overlap(nd.multiset(a, memo), nd.multiset(b, memo)) == pytest.approx(jaccard(counter(a), counter(b)))


def test_dropping(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(5, text, "p"), (3, text + " more", "q"), (3, text + " more", "q"), (7, "another text", "r"), (None, text, "s"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string")
    kept = nd.drop_near_documents(df)
    assert kept.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 3, 7, 9]
    assert nd.drop_near_documents(df.limit(0)).count() == 0
    assert nd.near_documents(df.filter("doc_id = 7")).first().kept


def test_components(spark):
    draw = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + draw.randrange(1, 300)) for _ in range(200)] + [(5000, 5001), (5002, 5001), (7, 7), (None, 3)]
    draw.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[5002] == got[5001] == got[5000] == 5000
    assert {got[n] for n in got if 1000 <= n < 1300} == {1000}
    assert components(edges.limit(0)).count() == 0


def test_query(spark):
    from tabweave.llm.queries import op4_near_documents

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op4_near_documents(spark, sf).select("doc_id", "group_id", F.col("kept")).collect()
    assert {r.doc_id: r.group_id for r in got} == brute(rows)
