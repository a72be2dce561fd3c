from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import spellings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, letters=5, least=3, damage=97):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def one_edit(word):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for i in range(len(word) + 1):
        for a in spellings.LETTERS:
            out |= {word[:i] + a + word[i:], word[:i] + a + word[i + 1 :]}
    return out - {word}


def plain_forms(counts, ratio=2):
    near = {w: one_edit(w) & counts.keys() for w in counts}
    best = {w: min(s, key=lambda x: (-counts[x], x), default=None) for w, s in near.items()}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)


def found(spark, counts, **options):
    return sorted(tuple(r) for r in spellings.spelling_forms(frame(spark, counts), **options).collect())


def vocabulary(seed, count=400):
    draw = random.Random(seed)
    letters = "abé÷"
    words = {"".join(draw.choice(letters) for _ in range(draw.choice([5, 5, 6, 7, 12]))) for _ in range(count)}
    return {w: draw.choice([3, 3, 4, 6, 8, 50, 1000]) for w in words}


@pytest.mark.parametrize("classes", [1, 2, 5])
def test_against_plain_search(spark, classes):
    counts = vocabulary(classes)
    got = found(spark, counts, classes=classes)
    assert got == plain_forms(counts) and sum(r[4] for r in got) > 300


def test_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(spellings, "BLOCK_LETTERS", 20)
    monkeypatch.setattr(spellings, "SALT_BLOCKS", 2)
    monkeypatch.setattr(spellings, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(spellings, "CANDIDATES", 7)
    counts = vocabulary(9)
    assert found(spark, counts, classes=1) == plain_forms(counts)


def test_chains_of_forms(spark):
    counts = {"a" * (5 + i): 3 * 2**i for i in range(20)}
    got = found(spark, counts)
    assert got == plain_forms(counts) and {r[2] for r in got} == {"a" * 24}


def test_long_words_and_ties(spark):
    counts = {"x" * 9000: 3, "x" * 9001: 7, "x" * 4000 + "y" + "x" * 4999: 6, "abcde": 5, "abcdf": 10, "abcda": 10, "abcdeé": 3, "vwxyz": 4}
    short = {w: n for w, n in counts.items() if len(w) < 100}
    got = {r[0]: r[1:] for r in found(spark, counts)}
    assert [(w, *got[w]) for w in sorted(short)] == plain_forms(short)
    assert got["x" * 9000] == ("x" * 9001, "x" * 9001, 3, 2, 7)
    assert got["x" * 4000 + "y" + "x" * 4999] == (None, "x" * 4000 + "y" + "x" * 4999, 6, 1, None)


def test_checksums_of_joined_texts():
    draw = np.random.default_rng(1)
    shift = spellings.CrcShift()
    heads = [draw.bytes(int(draw.integers(0, 9))) for _ in range(50)]
    tails = [draw.bytes(int(draw.integers(0, 200))) for _ in range(50)]
    sums = [np.array([zlib.crc32(x) for x in part], dtype=np.uint32) for part in (heads, tails)]
    got = shift.joined(*sums, np.array([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(h + t) for h, t in zip(heads, tails)]


@pytest.mark.parametrize("batch", [100, 10_000_000])
def test_words_of_texts(spark, monkeypatch, batch):
    monkeypatch.setattr(spellings, "SCAN_BYTES", batch)
    draw = random.Random(3)
    pieces = ["Hello", "ÉTUDE", "élève", "naïve", "a×b÷c", "東京tower", "word2word", "Ācaron", "ÿÿÿÿÿ", "don't", "q" * 300, "¿ÀÿĀ", "plain", "words"]
    rows = [(draw.choice([None, i, 10**15 + i, -i]), " ".join(draw.choices(pieces, k=draw.randrange(30)))) for i in range(300)]
    rows += [(5, None), (6, ""), (7, "plain words " * 3), (7, "plain words " * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.word: r.n for r in spellings.count_words(df, damage=7).collect()}
    assert got == plain_words(rows, damage=7)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "hello hello hello hullo hullo hullo hullo hullo hullo")], "doc_id bigint, text string")
    clash = df.withColumns({c: F.lit(1) for c in ("key", "word", "n", "cell", "a.b")})
    rows = spellings.spelling_forms(spellings.count_words(clash)).collect()
    assert sorted(r.word for r in rows) == ["hello", "hullo"]
    assert spellings.spelling_forms(spellings.count_words(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spellings.spelling_forms(spellings.count_words(df), ratio=1)


def test_query(spark):
    from tabweave.llm.queries import op13_spelling_forms

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op13_spelling_forms(spark, sf).collect()) == plain_forms(plain_words(rows))
