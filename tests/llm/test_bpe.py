from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tabweave.llm import bpe  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "e", "th", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "中文", "1", "23", "!!!", "\xa0", "\U0001f600", "er", "ing", "AA", "aaaa", "#", "\r\n", "\u3000", "\u0301", "Ⅷ", ".", ",", "\x1c", "\x85", "\u200b"]


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def texts(n: int) -> list[str]:
    draw = random.Random(5)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(n)]


def test_same_ids_as_the_library(coder, library):
    for text in texts(4000):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_same_ids_in_batches(coder, library):
    given = [*texts(4000), None, "", " ", "one two  three", None]
    ids, counts = coder.chunks.encode(pa.array(given))
    at = 0
    for text, n in zip(given, counts):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text or "")
        at += n
    assert at == len(ids)


def test_long_pieces(coder, library):
    draw = random.Random(6)
    for text in ["a" * 5000, "".join(draw.choices("abcdefghij", k=5000)), "x" * 3 + "-" * 4000, " " * 3000, "\U0001f600" * 700]:
        assert coder.encode(text) == library.encode_ordinary(text)
        assert coder.decode(coder.encode(text)).decode() == text


def test_compatibility_is_what_merging_says(coder, library):
    draw = random.Random(7)
    some = draw.sample(sorted(coder.halves), 300)
    for left, right in zip(some, draw.sample(some, len(some))):
        joined = coder.bytes_of[left] + coder.bytes_of[right]
        assert coder.compatible(left, right) == (library._encode_single_piece(joined) == [left, right] if joined not in coder.ranks else False)


def test_tables(spark):
    rows = [(1, "The end.", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "é é", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `ids ` string")
    encoded = bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS).collect()
    assert [r.text or "" for r in decoded] == [bytes(r.bytes).decode() for r in decoded] and len(decoded) == 5
    assert decoded[0]["ids "] == "x"
    clash = bpe.encode_texts(df.withColumn("IDS", df.doc_id), RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "ids ", "ids"]
    assert bpe.encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    one = encoded.select(bpe.id_digest("ids").alias("d"), "ids").first()
    assert one.d == hashlib.sha256(",".join(map(str, one.ids)).encode()).hexdigest()


def test_query_against_the_library(spark, library):
    from tabweave.llm.queries import op2_byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
