"""Token ids in files: frequency ranks in whole bytes, with the byte counts apart.

A file holds blocks of consecutive documents, each complete in itself: the block's ids by falling frequency (the rank
table), two bits per token for the number of bytes of its rank (the control stream, four tokens to a byte), and the ranks
in that many little-endian bytes (the data stream). Frequent ids take one byte. The reader looks all lengths of a control
byte up in a table and gathers the bytes with numpy. Blocks are rows of binary columns in Parquet, so that any store
Spark writes to will do and a repeated task leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.chunks import ChunkEncoder
from tabweave.llm.common import col, new_path, slices
from tabweave.llm.ordered import id_cuts, sorted_ranges

# Tokens after which a block is closed, after the document at hand.
BLOCK_TOKENS = 2_000_000
# Bytes of text encoded together, at least one document, and pieces whose ids a worker remembers: both save equal pieces.
ENCODED_BYTES, PIECES = 8_000_000, 800_000
# Ids below this are counted by their own number.
COUNTED_IDS = 1 << 20

# Lengths of the four ranks that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


# The letter that byte-level vocabularies write for a space, and chunks encoded as one text.
SPACE = chr(0x100 + 0x20)
JOINED_CHUNKS = 1_000
# A chunk that ends in a letter or digit and marks, or goes on in a new line with a word and marks: the pattern of byte-level
# vocabularies ends a token before the marks, and before and after a single line break. Letters are those of Latin alphabets.
WORD = "0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
MARKS = r"[!-/:-@\[-`{-~]"
CUT = rf"^(?P<first>\S*[{WORD}])(?P<marks>{MARKS}*)(?P<rest>(?:\n[{WORD}]+{MARKS}*)?)$"


class LibraryEncoder:
    """The tokenizers library. Chunks between single spaces are encoded many at a time, as one text: where the vocabulary is
    byte-level, the tokens that open with a space show where each of them begins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The library finds added tokens, special ones included, anywhere in a text. Those that reach over white space, or look
        # beyond their own letters, may not meet a cut.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.wide = tuple(t.content.strip() for t in added if any(map(str.isspace, t.content)) or t.lstrip or t.rstrip or t.single_word)
        rule = self.tokenizer.pre_tokenizer
        known = isinstance(rule, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.joins = known and rule.use_regex and not rule.add_prefix_space
        # Chunks that hold an added token are not cut.
        self.added = [t.content for t in added if t.content]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith(SPACE)]] = True

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """The first piece, marks and rest of each chunk; marks and rest are empty where it is not cut."""
        found = pc.extract_regex(chunks, CUT)
        whole = found.is_null()
        for mark in self.added:
            whole = pc.or_(whole, pc.match_substring(chunks, mark))
        marks, rest = (pc.if_else(whole, "", pc.struct_field(found, n)) for n in ("marks", "rest"))
        return pc.if_else(whole, chunks, pc.struct_field(found, "first")), marks, rest

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids, as bytes, of a space and each chunk; chunks hold no space."""
        parts = [chunks[i : i + JOINED_CHUNKS] for i in range(0, len(chunks), JOINED_CHUNKS)]
        out = []
        for part, ids in zip(parts, self([" " + " ".join(p) for p in parts]) if self.joins else [[]] * len(parts)):
            found = np.array(ids, dtype=np.int32)
            begin = np.flatnonzero(self.opens[found]).tolist()
            if len(begin) == len(part):
                held = found.tobytes()
                out += [held[4 * i : 4 * j] for i, j in zip(begin, [*begin[1:], len(found)])]
            else:
                out += [np.array(ids, dtype=np.int32).tobytes() for ids in self([" " + c for c in part])]
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> ChunkEncoder:
    """The library's encoder behind a memo of pieces, built once per worker."""
    encoder = LibraryEncoder(path)
    return ChunkEncoder(encoder, PIECES, whole_if=encoder.wide, encode_chunks=encoder.chunks, cut=encoder.cut if encoder.joins else None)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rank table, control stream and data stream of ids."""
    if len(ids) and ids.max() < COUNTED_IDS:
        # Small ids are counted in place, without a sort.
        every = np.bincount(ids)
        table = np.flatnonzero(every).astype(ids.dtype)
        counts = every[table]
    else:
        table, counts = np.unique(ids, return_counts=True)
    order = np.lexsort((table, -counts))
    if len(ids) and ids.max() < COUNTED_IDS:
        rank_of = np.empty(int(ids.max()) + 1, dtype=np.uint32)
        rank_of[table[order]] = np.arange(len(table), dtype=np.uint32)
        ranks = rank_of[ids]
    else:
        rank_of = np.empty(len(table), dtype=np.uint32)
        rank_of[order] = np.arange(len(table), dtype=np.uint32)
        ranks = rank_of[np.searchsorted(table, ids)]
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = sizes - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    # No rank takes more than so many bytes.
    width = 2 if len(table) <= 1 << 16 else 4
    data = ranks.astype(f"<u{width}").view(np.uint8)[(np.arange(width, dtype=np.uint8) < sizes[:, None]).reshape(-1)]
    return table[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(table: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ids of a block."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    stream = np.frombuffer(data, dtype=np.uint8)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = stream[starts].astype(np.uint32)
    for extra in (1, 2, 3):
        longer = np.flatnonzero(sizes > extra)
        if not len(longer):
            break
        ranks[longer] |= stream[starts[longer] + extra].astype(np.uint32) << np.uint32(8 * extra)
    return np.frombuffer(table, dtype="<u4")[ranks]


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the ids to ``path`` in ascending order of ``key``.

    Ids are those of the library's plain ``encode`` without special tokens around the text; the strings of added tokens
    inside a text become their ids, as the library has it. Texts are encoded where they are read and only ids are shuffled, into ranges of ids that one task each sorts and
    writes. Null and empty texts are the end id alone; null keys come first; documents that share a key are ordered by a
    hash of their texts. ``vocabulary`` is a file of the tokenizers library that every worker can read.
    """
    held = df.select(col(key).cast("bigint").alias("doc"), col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = id_cuts(held, "doc", "text", "tie")
    numbers = held.sparkSession.sparkContext.broadcast(cuts)
    rows = held.select(F.col("doc").isNotNull().alias("known"), F.coalesce("doc", F.lit(0)).alias("id"), "tie", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            known, ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "id", "tie"))
            places = numbers.value.places(known.astype(bool), ids, ties)
            docs = pa.array(ids, pa.int64(), mask=~known.astype(bool))
            for i, j in slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), ENCODED_BYTES):
                found, counts = encoder.encode(texts.slice(i, j - i))
                # Ids of up to two bytes are stored in two.
                narrow = found.astype("<u2") if not len(found) or found.max() < 1 << 16 else found.astype("<u4")
                width = narrow.dtype.itemsize
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))) * width, pa.int64())
                encoded_ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, offsets.buffers()[1], pa.py_buffer(narrow.tobytes())])
                sizes = pa.array(np.full(j - i, width, dtype=np.int32))
                columns = [docs.slice(i, j - i), pa.array(places[i:j]), pa.array(ties[i:j]), sizes, encoded_ids.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "part", "tie", "width", "ids"])

    encoded = rows.mapInArrow(encode, "doc bigint, part int, tie bigint, width int, ids binary")
    ordered = sorted_ranges(encoded, "part", len(cuts) + 1, [F.asc_nulls_first("doc"), "tie"])
    ordered = ordered.select("doc", "part", "width", "ids")

    def block(part: int, number: int, docs: list, held: list[np.ndarray]) -> pd.DataFrame:
        ids = np.concatenate(held)
        table, control, data = pack(ids)
        lengths = np.array([len(h) for h in held], dtype="<i8").tobytes()
        keys = [-1 if d is None else d for d in docs]
        nulls = np.array([d is None for d in docs], dtype=np.uint8).tobytes()
        row = (part, number, len(docs), len(ids), np.array(keys, dtype="<i8").tobytes(), nulls, lengths, table, control, data)
        return pd.DataFrame([row], columns=BLOCK)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, held, total, part = 0, [], [], 0, 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, part, width, ids in zip(*(batch.column(i) for i in range(4))):
                found = np.frombuffer(ids.as_buffer(), dtype=f"<u{width.as_py()}").astype("<u4")
                docs.append(doc.as_py())
                held.append(np.concatenate((found, end)))
                total, part = total + len(found) + 1, part.as_py()
                if total >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pandas(block(part, number, docs, held), SCHEMA)
                    number, docs, held, total = number + 1, [], [], 0
        if docs:
            yield pa.RecordBatch.from_pandas(block(part, number, docs, held), SCHEMA)

    ordered.mapInArrow(write, BLOCK_DDL).write.parquet(path)


BLOCK = ["part", "block", "n_docs", "n_tokens", "docs", "nulls", "lengths", "ranks", "control", "data"]
BLOCK_DDL = "part int, block int, n_docs bigint, n_tokens bigint, docs binary, nulls binary, lengths binary, ranks binary, control binary, data binary"
SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())] + [(c, pa.binary()) for c in BLOCK[4:]])


def read_token_files(df: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of files read with ``spark.read.parquet``.

    ``start`` counts the tokens of all documents before. Blocks are decoded one by one in parallel.
    """
    # One row per block; blocks of a range are few, and so are ranges.
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = df.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before("n", earlier.orderBy("part")).alias("range_before"))
    inner = df.select("part", "block", before("n_tokens", earlier.partitionBy("part").orderBy("block")).alias("inner_before"))
    placed = inner.join(ranges, "part").select("part", "block", (F.col("range_before") + F.col("inner_before")).alias("before"))
    rows = df.join(placed, ["part", "block"]).select("before", *BLOCK[3:])
    kinds = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = unpack(row["ranks"], row["control"], row["data"], row["n_tokens"])
                lengths = np.frombuffer(row["lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                view = memoryview(np.ascontiguousarray(found, dtype="<u4")).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                nulls = np.frombuffer(row["nulls"], dtype=np.uint8).astype(bool)
                columns = [
                    pa.array(np.frombuffer(row["docs"], dtype="<i8"), pa.int64(), mask=nulls),
                    pa.array(row["before"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ]
                if ids:
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32"] + (["ids"] if ids else []))

    return rows.mapInArrow(read, kinds)


def token_files(df: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Write the token files of ``df`` to a new folder of the shared folder and read them back."""
    path = new_path(df.sparkSession, "token-files")
    write_token_files(df, path, vocabulary, end_id, key, text)
    return read_token_files(df.sparkSession.read.parquet(path), key, ids)
