from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from tabweave.llm import phrases  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, scale=1000, share=100, longest=5):
    """Phrases of ``(text, lang)`` rows by plain counting."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer: dict = {}
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer.get((lang, p[i : i + m]), 0), a)
    found = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * longer.get((lang, p), 0) < share * a:
            score, k = min((scale * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in found.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])
    )


def corpus(seed, count=300):
    draw = random.Random(seed)
    words = ["the", "The", "of", "état", "ß", "東京", "a-b", "x y", "😀", "no", "New", "york", "city"] + [f"w{i}" for i in range(20)]
    gaps = [" "] * 12 + ["  ", "\t", " \t ", ". ", ", ", "\n", "!?", "\r\n", "\x0b", ";"]
    rows = []
    for _ in range(count):
        text = "".join(draw.choice(words[: draw.choice([4, 13, 33])]) + draw.choice(gaps) for _ in range(draw.randrange(60)))
        rows.append((draw.choice([text, text, text, "New York City hall. " * 3, "", None]), draw.choice(["en", "en", "fr", None, "und"])))
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counting(spark, seed):
    rows = corpus(seed)
    assert mined(spark, rows, least=5) == brute(rows, 5)


def test_collisions_are_told_apart_by_words(spark):
    rows = corpus(3)
    got = mined(spark, rows, least=4, mask=0x7F)
    assert got == brute(rows, 4) and len(got) > 128


def test_share_top_and_length(spark):
    rows = corpus(4)
    got = mined(spark, rows, least=5, top=7, share=60, longest=3, scale=10)
    assert got == brute(rows, 5, top=7, share=60, longest=3, scale=10)


def test_small_batches_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SCAN_BYTES", 200)
    monkeypatch.setattr(phrases, "RANKED_PARTS", 2)
    rows = [("Big data is big. " * 3000, "en"), ("x" * 100_000, "en"), *corpus(5, 40)]
    assert mined(spark, rows, least=5) == brute(rows, 5)


def test_odd_tables(spark):
    df = spark.createDataFrame([("a b", None)] * 3, "text string, lang string")
    clash = df.withColumns({"fp": F.lit(1), "doc": F.lit(None).cast("int"), "n": F.lit("x"), "seed": F.lit(2), "a.b": F.lit(3)})
    assert [tuple(r) for r in phrases.collocations(clash, least=3).collect()] == [("und", 1, "a b", 3, 3, 3, 6, 2000)]
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string"), least=1).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = {"a": 10**12 + 7, "b": 3 * 10**12 + 1, "a b": 10**12 + 3}
    held = spark.createDataFrame([("en", len(p.split()), p, n) for p, n in counts.items()], "lang string, size int, phrase string, n bigint")
    totals = spark.createDataFrame([("en", 10**14 + 9)], "lang string, total bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (held, totals))
    row = phrases.collocations(held).first()
    assert row["score"] == 1000 * counts["a b"] * (10**14 + 9) // (counts["a"] * counts["b"])


def test_query(spark):
    from tabweave.llm.queries import op11_collocations

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in op11_collocations(spark, sf).collect()) == brute(rows, 100)
