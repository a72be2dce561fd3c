from __future__ import annotations

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tabweave.llm import token_files as tf  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 1000, 70_000])
def test_blocks_round_trip(count):
    draw = np.random.default_rng(count)
    ids = (draw.pareto(0.4, count) * 3).clip(0, 2**32 - 1).astype(np.uint32)
    table, control, data = tf.pack(ids)
    assert len(control) == -(-count // 4)
    assert (tf.unpack(table, control, data, count) == ids).all()


def test_more_than_two_bytes_of_rank():
    ids = np.arange(200_000, dtype=np.uint32)
    assert (tf.unpack(*tf.pack(ids), len(ids)) == ids).all()


def test_frequent_ids_take_one_byte():
    ids = np.array([70_000] * 1000 + list(range(300)), dtype=np.uint32)
    table, _, data = tf.pack(ids)
    assert np.frombuffer(table, dtype="<u4")[0] == 70_000 and len(data) < 1000 + 256 + 2 * 50


def expected(rows, library, end=2):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_documents_in_order(spark, library, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_TOKENS", 50)
    rows = [(i * 7 % 101, f"Text {i}, <|endoftext|> and\n more  of it. " * (i % 5)) for i in range(101)] + [(500, None), (501, "é" * 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in tf.token_files(df, PATH, 2).orderBy("doc_id").collect()]
    assert got == expected(sorted(rows), library)


def test_special_tokens_inside_texts(spark, library):
    texts = ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b c", " <|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "end <|endoftext|>\n\n next"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [50256]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [tuple(r) for r in tf.token_files(df, PATH, 2).orderBy("doc_id").collect()] == expected(rows, library)


def test_added_tokens_that_reach_over_spaces(library):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.add_tokens([tokenizers.AddedToken("big deal", normalized=False), tokenizers.AddedToken("wide", lstrip=True), tokenizers.AddedToken("one", single_word=True)])
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".json") as file:
        tokenizer.save(file.name)
        encoder = tf.library_encoder(file.name)
    texts = ["a big deal now", "so wide it is", "some one or none", "no such words here", None]
    ids, counts = encoder.encode(tf.pa.array(texts))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_ranges_split_equal_and_missing_ids(spark):
    from tabweave.llm.ordered import Cuts

    draw = np.random.default_rng(5)
    known, ids, ties = draw.random(2000) < 0.6, draw.integers(0, 4, 2000), draw.integers(-50, 50, 2000)
    triples = sorted(zip(known.tolist(), np.where(known, ids, 0).tolist(), ties.tolist()))
    cuts = sorted(set(triples[::100]))
    got = Cuts(*(np.array(c) for c in zip(*cuts))).places(known, np.where(known, ids, 0), ties)
    want = [sum(c <= t for c in cuts) for t in zip(known.tolist(), np.where(known, ids, 0).tolist(), ties.tolist())]
    assert got.tolist() == want and len(set(want)) > 15
    df = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)], "doc_id bigint, text string")
    rows = tf.token_files(df, PATH, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 300 + [7] * 300 and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)


def test_odd_tables(spark, library):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (2, "")], "doc_id bigint, text string").withColumns({})
    got = tf.token_files(df.selectExpr("*", "1 AS part", "2 AS ids", "3 AS start"), PATH, 2).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (2, 2, 1), (3, 3, 2), (3, 5, 2)]
    assert tf.token_files(df.limit(0), PATH, 2).count() == 0


def test_query(spark, library):
    from tabweave.llm.queries import op10_token_files

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = [tuple(r) for r in op10_token_files(spark, sf).orderBy("doc_id").collect()]
    assert got == [e[:4] for e in expected(docs, library)]


def test_pieces_of_chunks_are_encoded_once(library):
    """Marks at the end of a word and a single line break are cut off, where tokens surely end."""
    encoder = tf.library_encoder.__wrapped__(PATH)
    asked = []
    encode = encoder.encode_chunks
    encoder.encode_chunks = lambda chunks: (asked.extend(chunks), encode(chunks))[1]
    texts = ["so word word. word, word!!\nword (word word's word's, word\nword? word", "a word word; word_ end"]
    ids, counts = encoder.encode(tf.pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert sorted(asked) == sorted(set(asked)) and not {"word.", "word,", "word!!\nword", "word;"} & set(asked)


def test_cut_pieces_equal_whole_texts(library):
    draw = np.random.default_rng(8)
    letters = ["a", "Z", "é", "ß", "×", "7", "²", "'", "'s", "'ll", ".", ",", "_", "$$", "»", "…", "\n", "\n\n", "\t", "\r", "\x0b", " ", " ", "́", "Ω", "字", " ", " ", " ", "  ", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(letters[i] for i in draw.integers(0, len(letters), draw.integers(0, 40))) for _ in range(6_000)]
    encoder = tf.library_encoder.__wrapped__(PATH)
    for part in (texts, texts[::-1]):
        ids, counts = encoder.encode(tf.pa.array(part))
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
