"""Byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that one trie over all tokens finds the longest match at a place. A piece is covered from the left with the longest token that fits; a token may follow another only if merging their
joined bytes would give just these two, which is decided once per pair and memoised. Where no token fits, the last one
is shortened. That gives the merges of the rank file in time linear in the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.chunks import ChunkEncoder
from tabweave.llm.common import BATCH_BYTES, slices

# Pairs whose compatibility is remembered at once.
MEMO_PAIRS = 400_000
# Chunks whose ids are remembered; a decoding worker often runs beside this one.
MEMO_CHUNKS = 160_000
# Marks that are one piece when they follow letters.
MARKS = ".,;:!?"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairCodec:
    """Encoder and decoder of one vocabulary; ``pattern`` cuts a text into pieces that are encoded by themselves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        made: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    continue  # no sequence of merges makes this token
                self.halves[rank] = parts[0], parts[1]
                self.joined[parts[0], parts[1]] = rank
            made[token] = rank
            self.trie.add_word(token.decode("latin-1"), rank)
        count = max(ranks.values()) + 1
        self.size_of = [0] * count
        # The longest token that is a shorter start of a token, or -1.
        self.shorter = [-1] * count
        for token, rank in made.items():
            self.size_of[rank] = len(token)
            self.shorter[rank] = next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
        self.pair = count
        self.rank_of = {token.decode("latin-1"): rank for token, rank in made.items()}
        self.widest = max(map(len, made))
        self.fits: dict[int, bool] = {}
        self.chunks = ChunkEncoder(lambda texts: [self.encode(t) for t in texts], MEMO_CHUNKS)

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The token's bytes after all merges of a rank below ``below``, the lowest first."""
        parts = [self.ranks.get(token[i : i + 1], -1) for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.joined.get((parts[i], parts[i + 1]), below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, joined, merge into just these two tokens.

        The merges are undone from the latest on, at the edge where the tokens meet: if two parts that touched there
        could have merged before the merge that hid one of them, the pair cannot stand.
        """
        key = left * self.pair + right
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        halves, joined = self.halves, self.joined
        answer, limit = True, float("inf")
        while True:
            rank = joined.get((left, right))
            if rank is not None and rank < limit:
                answer = False
                break
            # The part made last is opened; of parts with equal ranks the left one was made first.
            open_left = left in halves and (right not in halves or left > right)
            if open_left:
                limit, left = left, halves[left][1]
            elif right in halves:
                # A merge of the same rank further left came first.
                limit, right = right + 1, halves[right][0]
            else:
                break
        self.fits[key] = answer
        return answer

    def _longest(self, spelled: str, at: int) -> int:
        """The longest token at a place, or -1; the trie bounds its length, so a place costs one token's length at most."""
        ahead = spelled[at : at + self.widest]
        size, rank_of = self.trie.longest_prefix(ahead), self.rank_of
        while size:
            rank = rank_of.get(ahead[:size])
            if rank is not None:
                return rank
            size -= 1
        return -1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, size_of, shorter, fits = len(piece), self.size_of, self.shorter, self.fits
        spelled = piece.decode("latin-1")
        pair = self.pair
        closed: set[int] = set()
        ids: list[int] = []
        at, last, rank = 0, -1, self._longest(spelled, 0)
        while at < size:
            while rank >= 0:
                end = at + size_of[rank]
                if not closed or end not in closed:
                    if last < 0:
                        break
                    fit = fits.get(last * pair + rank)
                    if fit or fit is None and self.compatible(last, rank):
                        break
                rank = shorter[rank]
            if rank >= 0:
                ids.append(rank)
                at, last = end, rank
                rank = self._longest(spelled, at) if at < size else -1
                continue
            if not ids:
                raise ValueError("the vocabulary cannot spell this piece")
            # Nothing can start here: the token before is shortened.
            closed.add(at)
            last = ids.pop()
            at -= size_of[last]
            rank, last = shorter[last], ids[-1] if ids else -1
        return ids

    def _encode_exactly(self, text: str) -> list[int]:
        # Letters are one piece, with the space before them, and so are the marks behind them.
        letters = text.rstrip(MARKS)
        if letters[1:].isalpha() and (letters[0] == " " or letters[0].isalpha()):
            ids = self.encode_piece(letters.encode())
            return ids + self.encode_piece(text[len(letters) :].encode()) if len(letters) < len(text) else ids
        ids = []
        for piece in self.find(text):
            ids += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, empty for an empty text or null."""
        return self._encode_exactly(text) if text else []

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a worker; built once per process."""
    return BytePairCodec(read_ranks(path), pattern)


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids``, the token ids of the whole ``text``; null and empty texts have none.

    ``path`` names a rank file that every worker can read, ``pattern`` the split. A column called like ``ids`` is
    replaced. Repeated rows stay repeated. Nothing is shuffled.
    """
    rest = [f.name for f in df.schema.fields if f.name.lower() != ids.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            kept, texts = batch.select(rest), batch.column(batch.schema.get_field_index(text))
            for i, j in slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), BATCH_BYTES):
                found, counts = coder.chunks.encode(texts.slice(i, j - i))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.slice(i, j - i).columns, lists], [*rest, ids])

    return df.mapInArrow(run, _extended(df, ids, T.ArrayType(T.IntegerType())))


@lru_cache(maxsize=2)
def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of each id; built once per process."""
    return {rank: token for token, rank in read_ranks(path).items()}


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns but ``ids``, and ``out``, the bytes that the ids spell; a null list spells none.

    An id outside the vocabulary is an error. A column called like ``out`` is replaced.
    """
    rest = [f for f in df.schema.fields if f.name.lower() not in (out.lower(), ids.lower())]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = byte_table(path).__getitem__
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [b"".join(map(spell, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(texts, pa.binary())], [*names, out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.BinaryType())]))


def id_digest(ids: str) -> Column:
    """Lower-case SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
