"""Token ids of many texts at once, cut at sure places so that repeated words are encoded once.

A single space between other characters always starts a piece of the byte-level pattern. Texts are cut there in Arrow,
equal chunks are found by dictionary encoding, and only new chunks are given to the encoder. Texts with other runs of
white space are encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabweave.llm.common import MEMO_ENTRIES

KEPT_CHARS = 64


def as_list(values: pa.Array) -> list:
    """The values of an array without nulls, sooner than one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


def dictionary_chunks(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(codes, offsets, chunks)``: the chunk numbers of all texts, where each text starts, and the distinct chunks."""
    codes, offsets, chunks = arrow_chunks(texts, split)
    return codes, offsets, as_list(chunks)


def arrow_chunks(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``dictionary_chunks`` with the chunks in Arrow."""
    lists = split(texts.fill_null(""))
    values = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return values.indices.to_numpy(zero_copy_only=False), offsets, values.dictionary


def word_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``dictionary_chunks`` between white space, without the empty ones at the ends of texts."""
    codes, offsets, chunks = dictionary_chunks(texts, pc.utf8_split_whitespace)
    if "" in chunks:
        keep = codes != chunks.index("")
        codes, offsets = codes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    return codes, offsets, chunks


class ChunkEncoder:
    """``encode_many`` turns texts into lists of ids; of a worker's latest ``memo`` chunks or so the ids are remembered.

    Texts that hold one of the strings ``whole_if`` are encoded whole. ``encode_chunks`` is a quicker way to the ids, as bytes, of
    a space and each of some chunks. ``cut`` parts chunks into a first piece, marks and a rest between which tokens surely end;
    pieces repeat more often than chunks and are remembered instead of them.
    """

    def __init__(
        self, encode_many: Callable[[list[str]], list[list[int]]], memo: int = MEMO_ENTRIES, whole_if: tuple[str, ...] = (),
        encode_chunks: Callable[[list[str]], list[bytes]] | None = None,
        cut: Callable[[pa.Array], tuple[pa.Array, pa.Array, pa.Array]] | None = None,
    ):
        self.cut = cut
        self.ends: dict[str, bytes] = {}
        self.encode_many, self.memo, self.whole_if = encode_many, memo, whole_if
        self.encode_chunks = encode_chunks or (lambda chunks: self._packed([" " + c for c in chunks]))
        # Ids of a chunk as bytes, or False for a chunk that is not sure.
        self.young: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.encode_many(texts)] if texts else []

    def _known(self, chunks: list[str]) -> list[bytes | bool]:
        """Ids of a space and each chunk; False for chunks that are not sure."""
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        asked = [chunks[i] for i in missing]
        held = list(map(old.get, asked))
        # Sure of its bounds is a chunk without white space at its ends.
        held = [False if ids is None and (not c or c.strip() != c) else ids for c, ids in zip(asked, held)]
        encoded = iter(self.encode_chunks([c for c, ids in zip(asked, held) if ids is None]))
        held = [next(encoded) if ids is None else ids for ids in held]
        for i, ids in zip(missing, held):
            found[i] = ids
        young.update((c, ids) for c, ids in zip(asked, held) if len(c) <= KEPT_CHARS)
        if len(young) >= self.memo // 2:
            self.old, self.young = young, {}
        return found

    def _ends(self, pieces: pa.Array) -> list[bytes]:
        """Ids of pieces that no space precedes; most are empty."""
        held = pieces.dictionary_encode()
        distinct = as_list(held.dictionary)
        fresh = [p for p in distinct if p and p not in self.ends]
        new = dict(zip(fresh, self._packed(fresh)))
        packed = [new[p] if p in new else self.ends.get(p, b"") for p in distinct]
        if len(self.ends) + len(new) > self.memo // 4:
            self.ends = {}
        self.ends.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_CHARS)
        return list(map(packed.__getitem__, as_list(held.indices)))

    def _cut_known(self, chunks: pa.Array) -> list[bytes | bool]:
        """``_known`` by the pieces of the chunks."""
        first, marks, rest = self.cut(chunks)
        held = first.dictionary_encode()
        known = self._known(as_list(held.dictionary))
        packed = map(known.__getitem__, as_list(held.indices))
        return [a and (a + b + c if b or c else a) for a, b, c in zip(packed, self._ends(marks), self._ends(rest))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts in a row and how many each has; nulls count as empty."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, offsets, chunks = arrow_chunks(texts, lambda t: pc.split_pattern(t, " "))
        packed = self._cut_known(chunks) if self.cut else self._known(as_list(chunks))
        unsure = np.array([p is False for p in packed], dtype=bool)
        # A text's first chunk has no space before it: it gets an entry of its own, as has a text encoded whole.
        heads = codes[offsets[:-1]]
        inner = unsure[codes]
        inner[offsets[:-1]] = False
        whole = np.add.reduceat(inner, offsets[:-1]) > 0
        whole |= unsure[heads] & (np.diff(offsets) > 1)
        for mark in self.whole_if:
            whole |= pc.match_substring(texts.fill_null(""), mark).to_numpy(zero_copy_only=False)
        first = as_list(chunks.take(pa.array(heads)))
        own = [texts[i].as_py() or "" if w else h for i, (w, h) in enumerate(zip(whole.tolist(), first))]
        packed += self._packed(own)
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(chunks) + np.arange(len(own))
        if whole.any():
            keep = ~np.repeat(whole, np.diff(offsets))
            keep[offsets[:-1]] = True
            codes = codes[keep]
        kept = np.where(whole, 1, np.diff(offsets))
        packed = [p or b"" for p in packed]
        flat = np.frombuffer(b"".join(packed), dtype=np.int32)
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        before = np.cumsum(lengths) - lengths
        ids = flat[np.repeat(starts[codes] - before, lengths) + np.arange(int(lengths.sum()))]
        counts = np.add.reduceat(lengths, np.cumsum(kept) - kept).astype(np.int64)
        return ids, counts
