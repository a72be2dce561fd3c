from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabweave.llm import fingerprints as fp


def words(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzé", k=draw.randint(2, 9))) for _ in range(n))


def shingles(text: str) -> set[str]:
    k = fp.SHINGLE_CHARS
    return {text[i : i + k] for i in range(len(text) - k + 1)} if len(text) >= k else {text} if text else set()


def likeness(a: str, b: str) -> float:
    return fp.likeness(*(fp.sketch(fp.code_points(t)) for t in (a, b)))


def test_text_form_keeps_the_hashes():
    draw = random.Random(1)
    for n in (0, 1, 5, 500):
        hashes = fp.sketch(fp.code_points(words(draw, n)))
        text = fp.to_text(hashes)
        assert (fp.from_text(text) == hashes).all() and len(text) == 7 * len(hashes)
        cut = [text[i : i + 7] for i in range(0, len(text), 7)]
        assert cut == sorted(cut)


def test_share_of_hashes_and_floor():
    text = words(random.Random(2), 5000)
    share = len(fp.sketch(fp.code_points(text))) / len(shingles(text))
    assert share == pytest.approx(1 / 16, rel=0.1)
    assert len(fp.sketch(fp.code_points(text[:40]))) == fp.FLOOR
    assert len(fp.sketch(fp.code_points("short"))) == 1 and len(fp.sketch(fp.code_points(""))) == 0


def test_union_is_merged_from_the_parts():
    draw = random.Random(3)
    a, b = words(draw, 2000), words(draw, 3000)
    whole = set(fp.sketch(fp.code_points(a + b)).tolist())
    merged = {*fp.sketch(fp.code_points(a)).tolist(), *fp.sketch(fp.code_points(b)).tolist()}
    # Only the shingles across the seam differ.
    assert merged <= whole and len(whole - merged) <= fp.SHINGLE_CHARS


@pytest.mark.parametrize("size", [60, 400, 3000])
def test_containment_of_unequal_texts(size):
    draw = random.Random(size)
    text = words(draw, size)
    for share in (0.25, 0.6, 1.0):
        part = text[: int(len(text) * share)]
        other = part + words(draw, size * 4)
        a, b = shingles(text), shingles(other)
        assert likeness(text, other) == pytest.approx(len(a & b) / min(len(a), len(b)), abs=0.25 if size < 100 else 0.12)
    assert likeness(text, words(draw, size)) < 0.02


def test_likeness_at_the_ends():
    assert likeness("same", "same") == 1 and likeness("", "") == 1
    assert likeness("same", "") == 0 and likeness("one", "other") == 0


def brute(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        prints = [fp.to_text(fp.sketch(fp.code_points(t))) for t in (text, edited)]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, likeness(text, edited), likeness(text, after))
    return out


def test_neighbours_against_brute_force(spark):
    draw = random.Random(9)
    rows = [(i * 13 % 211, words(draw, draw.choice([0, 1, 3, 40, 200]))) for i in range(211)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in fp.edited_neighbours(df.withColumn("part", F.lit(1)).withColumn("key", F.lit(2))).collect()}
    assert got == brute(rows)


def test_neighbours_of_odd_tables(spark):
    kinds = "doc_id bigint, text string"
    one = fp.edited_neighbours(spark.createDataFrame([(5, "abcdefgh")], kinds)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(5, 8, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(None, "n"), (1, None), (1, None), (2, "x" * 50), (2, "x" * 50), (3, "")]
    got = fp.edited_neighbours(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars) for r in got) == [(-1, 1), (1, 0), (1, 0), (2, 50), (2, 50), (3, 0)]
    assert fp.edited_neighbours(spark.createDataFrame([], kinds)).count() == 0
    same = spark.createDataFrame([(4, "same text")] * 30, kinds)
    assert fp.edited_neighbours(same).count() == 30


def test_column_of_fingerprints(spark):
    df = spark.createDataFrame([("a" * 30, 1), (None, 2), ("", 3)], "text string, FINGERPRINT int")
    rows = fp.fingerprint_texts(df).collect()
    assert [len(r.fingerprint) for r in rows] == [7, 0, 0]


def test_query(spark):
    from tabweave.llm.queries import op6_fingerprints

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r[0]: tuple(r)[1:] for r in op6_fingerprints(spark, sf).collect()} == brute(docs)
