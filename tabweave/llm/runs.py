"""Words of many texts at once: maximal runs of bytes found with numpy in the buffers of an Arrow array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Runs:
    """The runs of some texts in order."""

    codes: np.ndarray  # number of each run's word in `words`
    words: list[bytes]  # the distinct words
    doc: np.ndarray  # number of the text that each run is from
    start: np.ndarray  # place of each run's first byte in all texts put together


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)``: the UTF-8 bytes of all texts in a row and where each starts; nulls count as empty."""
    wide = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Runs:
    """Maximal runs of the bytes marked ``inside``; the start of a text ends the run before it."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] |= inside[heads]
    start = np.flatnonzero(starts)
    kept = data[inside]
    place = np.cumsum(inside)[start] - 1 if len(start) else start
    ends = pa.py_buffer(np.append(place, len(kept)).astype(np.int64).tobytes())
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, ends, pa.py_buffer(kept.tobytes())]).dictionary_encode()
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Runs(words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist(), doc, start)
