"""Spelling variants: words one letter apart, found by Gram matrices of letter counts, grouped under their commonest form.

Letter counts of two words one edit apart differ by a squared distance of two at most (two letters by one each if one
is replaced, one letter if one is put in). Words are cut into cells by how many letters of each of a few classes they hold, so
by length as well, and a word's partners lie in its own cell or in one that a single edit leads to. Cells are cut into
blocks of bounded size. For each pair of neighbouring blocks one NumPy product of their letter counts gives all squared
distances; only pairs at most two apart are compared letter by letter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import BROADCAST_ENTRIES
from tabweave.llm.common import col, saved, slices
from tabweave.llm.runs import find_runs, text_bytes

SCAN_BYTES = 8_000_000
# Letters of the words of a block; a longer word is a block of its own.
BLOCK_LETTERS = 4_096
# Blocks of a cell that meet another block in one task.
SALT_BLOCKS = 16
# Words that a cell should hold, as far as more classes of letters can bring it about.
CELL_WORDS = 200
MOST_CLASSES = 10
# Pairs compared letter by letter at a time.
CANDIDATES = 50_000
# One occurrence in so many runs, by their hash, loses a letter.
DAMAGE = 97

# The letters of words, in lower case where ASCII has one.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
PLACE = np.zeros(256, dtype=np.intp)
PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


@lru_cache(maxsize=1)
def _crc_byte() -> np.ndarray:
    """The CRC of each single byte without the inversions at both ends."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


class CrcShift:
    """What a CRC becomes when so many zero bytes follow; with it the CRC of two texts in a row comes from those of each."""

    def __init__(self):
        self.tables = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32))[None]

    def upto(self, length: int) -> np.ndarray:
        while len(self.tables) <= length:
            last = self.tables[-1]
            self.tables = np.concatenate((self.tables, (_crc_byte()[last & 0xFF] ^ (last >> 8))[None]))
        return self.tables

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of a text with CRC ``first`` followed by one of ``length`` bytes with CRC ``second``."""
        tables = self.upto(int(length.max(initial=0)))
        out = second.copy()
        for i in range(4):
            out ^= tables[length, i, (first >> np.uint32(8 * i)) & np.uint32(0xFF)]
        return out


# Longer runs are hashed one by one.
SHIFT_BYTES = 256


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters A-Z, a-z and U+00C0 to U+00FF; the latter are two bytes from 0xC3 on."""
    inside = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def _counted(texts: pa.Array, keys: list[str], shift: CrcShift, damage: int) -> dict[str, int]:
    """Occurrences of every word of some texts, damaged occurrences included."""
    data, offsets = text_bytes(texts)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    runs = find_runs(lower, offsets, _letters(data))
    counts = np.bincount(runs.codes, minlength=len(runs.words)).astype(np.int64)
    out: dict[str, int] = {}
    names = [w.decode() for w in runs.words]
    if len(runs.codes):
        sums = np.fromiter(map(zlib.crc32, runs.words), dtype=np.uint32, count=len(runs.words))
        sizes = np.fromiter(map(len, runs.words), dtype=np.int64, count=len(runs.words))
        heads = np.fromiter((zlib.crc32(k.encode() + b":") for k in keys), dtype=np.uint32, count=len(keys))
        long_runs = sizes > SHIFT_BYTES
        hashes = shift.joined(heads[runs.doc], sums[runs.codes], np.where(long_runs, 0, sizes)[runs.codes])
        for i in np.flatnonzero(long_runs[runs.codes]).tolist():
            hashes[i] = zlib.crc32(runs.words[runs.codes[i]], int(heads[runs.doc[i]]))
        hit = np.flatnonzero(hashes % np.uint32(damage) == 0)
        counts -= np.bincount(runs.codes[hit], minlength=len(counts))
        for code, h in zip(runs.codes[hit].tolist(), hashes[hit].tolist()):
            name = names[code]
            at = h % len(name)
            word = name[:at] + name[at + 1 :]
            out[word] = out.get(word, 0) + 1
    for name, n in zip(names, counts.tolist()):
        if n:
            out[name] = out.get(name, 0) + n
    return out


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least: int = 3, damage: int = DAMAGE) -> DataFrame:
    """``(word, n)`` of all words of ``least_letters`` code points and ``least`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. Where ``damage`` divides the CRC-32 of
    ``<key>:<run>``, the code point at that CRC modulo the length is left out. Null texts hold no words, a null key is an empty
    one; copies of rows count again; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = CrcShift()
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SCAN_BYTES):
                found = _counted(texts.slice(i, j - i), batch.column(0).slice(i, j - i).to_pylist(), shift, damage)
                kept = {w: n for w, n in found.items() if len(w) >= least_letters}
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    held = df.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    counted = held.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def _classes(count: int) -> list[str]:
    """The alphabet in ``count`` classes, dealt round in order."""
    return [LETTERS[i::count] for i in range(count)]


def _steps(classes: int) -> list[tuple[int, ...]]:
    """What one edit may add to a cell, of each edit and its reverse only one: nothing, a letter put in, or one replaced."""
    unit = lambda i: tuple(int(j == i) for j in range(classes))
    replaced = [tuple(a - b for a, b in zip(unit(i), unit(j))) for i in range(classes) for j in range(i)]
    return [tuple([0] * classes), *map(unit, range(classes)), *replaced]


def _cell(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda n: n.cast("string")), ",")


def _blocks(words: DataFrame, classes: int) -> DataFrame:
    """``(cell, counts, block, blocks, size, letters, ns)``: words of one cell and so of one length, as Latin-1 bytes."""
    held = F.array(*[F.length("word") - F.length(F.translate("word", c, "")) for c in _classes(classes)])
    placed = words.select("word", "n", held.alias("counts")).withColumn("cell", _cell(F.col("counts")))
    cells = saved(placed.groupBy("cell").agg(F.count("*").alias("words"), F.max(F.length("word")).alias("size")), "spelling-cells")
    per_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_LETTERS) / F.col("size")))
    sized = cells.select("cell", "size", F.ceil(F.col("words") / per_block).alias("blocks"))
    small = cells.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    dealt = placed.join(F.broadcast(sized) if small else sized, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    listed = dealt.groupBy("cell", "block").agg(
        F.first("counts").alias("counts"), F.first("blocks").alias("blocks"), F.first("size").alias("size"),
        F.collect_list(F.struct("word", "n")).alias("held"),
    )
    text = F.encode(F.array_join(F.transform("held", lambda h: h["word"]), ""), "ISO-8859-1")
    return saved(listed.select("cell", "counts", "block", "blocks", "size", text.alias("letters"), F.transform("held", lambda h: h["n"]).alias("ns")), "spelling-blocks")


def _vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts of the words in the rows of a matrix of Latin-1 bytes."""
    rows, width = letters.shape
    flat = PLACE[letters] + np.arange(rows)[:, None] * len(LETTERS)
    return np.bincount(flat.ravel(), minlength=rows * len(LETTERS)).reshape(rows, len(LETTERS)).astype(np.float32)


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _put_in(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the longer word without one letter is the shorter one: equal starts and equal ends cover it."""
    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= short.shape[1]


def near_pairs(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of words, equally long or one letter longer, that differ by one edit."""
    a, b = _vectors(short), _vectors(long)
    # Counts are small whole numbers, so the products are exact as long as words have fewer than 4,000 letters.
    if max(short.shape[1], long.shape[1]) >= 4_000:
        a, b = a.astype(float), b.astype(float)
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(squared <= 2)
    same = short.shape[1] == long.shape[1]
    step = max(1, CANDIDATES * 16 // max(16, long.shape[1]))
    kept = [(_replaced if same else _put_in)(short[i[k : k + step]], long[j[k : k + step]]) for k in range(0, len(i), step)]
    keep = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[keep], j[keep]


LINKS = "word string, n bigint, other string, other_n bigint"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            value = lambda name: batch.column(batch.schema.get_field_index(name))[row]
            sides = []
            for side in ("", "other_"):
                ns = value(f"{side}ns").values.to_numpy()
                sides.append((np.frombuffer(value(f"{side}letters").as_buffer(), dtype=np.uint8).reshape(len(ns), -1), ns))
            (short, m), (long, n) = sides
            i, j = near_pairs(short, long)
            if value("self").as_py():
                i, j = i[i < j], j[i < j]
            if len(i):
                one = [short[k].tobytes().decode("latin-1") for k in i.tolist()]
                two = [long[k].tobytes().decode("latin-1") for k in j.tolist()]
                columns = [one + two, np.concatenate((m[i], n[j])), two + one, np.concatenate((n[j], m[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "n", "other", "other_n"])


def near_words(words: DataFrame, classes: int | None = None) -> DataFrame:
    """``(word, n, other, other_n)``, both ways, of all words one edit apart among distinct ``words (word, n)``.

    The number of letter classes follows the number of words and changes the work only, never the result. Blocks of a
    crowded cell meet in several tasks; no task holds more than a pair of blocks at a time.
    """
    words = saved(words, "spelling-words")
    if classes is None:
        classes = min(MOST_CLASSES, max(2, round(math.log2(1 + words.count() / CELL_WORDS) / 2)))
    blocks = _blocks(words, classes)
    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps(classes)])).alias("step")
    reached = F.zip_with("counts", "step", lambda a, b: a + b)
    left = blocks.select("cell", "block", "counts", "letters", "ns", steps).select("cell", "block", "letters", "ns", _cell(reached).alias("to"))
    # How many salts a cell's blocks are spread over; also leaves cells out that no word is in.
    spread = F.ceil(F.col("blocks") / SALT_BLOCKS)
    cells = blocks.groupBy(F.col("cell").alias("to")).agg(F.max(spread).alias("salts"))
    small = cells.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    left = left.join(F.broadcast(cells) if small else cells, "to").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    right = blocks.select(
        F.col("cell").alias("to"), F.pmod("block", spread).alias("salt"), F.col("block").alias("other_block"),
        F.col("letters").alias("other_letters"), F.col("ns").alias("other_ns"),
    )
    met = left.join(right.hint("shuffle_hash"), ["to", "salt"]).filter((F.col("cell") != F.col("to")) | (F.col("block") <= F.col("other_block")))
    own = (F.col("cell") == F.col("to")) & (F.col("block") == F.col("other_block"))
    return met.select("letters", "ns", "other_letters", "other_ns", own.alias("self")).mapInArrow(_pairs, LINKS)


def spelling_forms(words: DataFrame, ratio: int = 2, classes: int | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of distinct ``words (word, n)``.

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if it has ``ratio`` times the word's, else
    null; ``root`` is where forms lead. An empty table gives an empty one. ``n`` rises along forms, so they end; roots are
    found by doubling the step in a few rounds.
    """
    if ratio < 2:
        raise ValueError("forms have to be commoner than their words, or they may run in circles")
    words = saved(words, "spelling-words")
    links = near_words(words, classes)
    # Of the largest n the smallest word: the minimum of (-n, word).
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    forms = saved(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    step = saved(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        step = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return forms.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
