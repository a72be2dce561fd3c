"""Collocations: frequent word sequences that hold together better than chance, by Rabin-Karp fingerprints.

Words are hashed, and numpy prefix polynomials over them give the fingerprint of every word sequence of a batch of texts in
a few array operations. What is shuffled is a fingerprint, a count, and in one number a second and independent fingerprint
and a pointer to a text that holds the sequence; never its words. Only sequences whose parts are frequent are counted: one scan counts words,
one counts pairs of frequent words, and one counts what is built of frequent pairs. Frequent parts are looked up in a bit
table of bounded size; a false hit costs a shuffled row and changes no result. Fingerprints that stand for more than one
sequence show in the second one and are counted again by their words; all others are spelled out from the one text
that each points to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.lookup import BROADCAST_ENTRIES
from tabweave.llm.common import col, mix, saved, slices
from tabweave.llm.runs import find_runs, text_bytes

# What ends a piece, and what parts words inside one.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
LONGEST = 5
NO_LANG = "und"
# Bytes of text fingerprinted together, at least one document.
SCAN_BYTES = 8_000_000
# A bit table has 16 bits for each frequent sequence, up to 2 ** MOST_BITS (16 MB).
MOST_BITS = 27
# Rows of a language ranked in one part before the parts' leaders are ranked together.
RANKED_PARTS = 64

BASE = np.uint64(0x9E3779B97F4A7C15)
# The inverse of BASE modulo 2 ** 64.
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SECOND_SEED = 1


def _marks(values: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


ENDS, GAPS = _marks(PIECE_ENDS), _marks(PIECE_ENDS + BLANKS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Powers:
    """``BASE ** i`` and its inverse for as many places as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, dtype=np.uint64))) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


class Scan:
    """The words of a batch of texts and the fingerprints of all their sequences.

    ``seeds`` go into the fingerprints: sequences of texts with different seeds never meet. ``mask`` keeps some bits of the
    first fingerprint only; tests use it to force collisions.
    """

    def __init__(self, texts: pa.Array, seeds: np.ndarray, powers: Powers, mask: int):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        runs = find_runs(data, offsets, ~GAPS[data])
        self.words, self.codes, self.doc, self.mask = runs.words, runs.codes, runs.doc, np.uint64(mask)
        self.seeds = seeds.view(np.uint64)[runs.doc] if len(runs.doc) else np.zeros(0, np.uint64)
        # Places where a sequence may not go on: ends of pieces and of texts.
        self.piece = np.cumsum(ENDS[data])[runs.start] if len(runs.start) else np.zeros(0, np.int64)
        n = len(self.codes)
        up, down = powers.upto(n + 1)
        self.up = up
        self.sums = []
        for seed in (0, SECOND_SEED):
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in runs.words), dtype=np.uint64, count=len(runs.words))
            self.sums.append(np.append(np.uint64(0), np.cumsum(hashes[self.codes] * down[:n])))

    def starts(self, size: int) -> np.ndarray:
        """Which words begin a sequence of ``size`` words inside a piece."""
        n = max(0, len(self.codes) - size + 1)
        last = slice(size - 1, size - 1 + n)
        return (self.piece[:n] == self.piece[last]) & (self.doc[:n] == self.doc[last])

    def prints(self, size: int, at: np.ndarray, second: bool = False) -> np.ndarray:
        """Fingerprints of the sequences of ``size`` words that begin ``at`` these words."""
        prefix = self.sums[second]
        found = mix(((prefix[at + size] - prefix[at]) * self.up[at]) ^ self.seeds[at] ^ np.uint64(size))
        return found if second else found & self.mask

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.words[c] for c in self.codes[at : at + size].tolist()).decode()


@dataclass
class BitTable:
    """A set of fingerprints with false hits: bit ``fp mod 2 ** bits``."""

    held: Broadcast
    bits: int

    def has(self, prints: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.held.value, dtype=np.uint8)
        place = prints & np.uint64((1 << self.bits) - 1)
        return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(prints: DataFrame, column: str, count: int) -> BitTable:
    """The bit table of a column of fingerprints. It is put together on the executors; its bytes, of bounded number, go by
    way of the driver."""
    bits = min(MOST_BITS, max(16, (16 * count).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    cell, bit = F.shiftright(place, 5), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(31)).cast("int"))
    cells = prints.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("held"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, held = b.column(0).to_numpy().astype("<u4"), b.column(1).to_numpy().astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([places.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], ["cell", "held"])

    table = np.zeros(1 << (bits - 5), dtype="<u4")
    for row in cells.mapInArrow(narrow, "cell binary, held binary").collect():
        table[np.frombuffer(row["cell"], dtype="<u4")] = np.frombuffer(row["held"], dtype="<u4")
    return BitTable(prints.sparkSession.sparkContext.broadcast(table.tobytes()), bits)


def _batches(batches: Iterator[pa.RecordBatch], mask: int) -> Iterator[tuple[pa.RecordBatch, Scan]]:
    powers = Powers()
    for batch in batches:
        for i, j in slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), SCAN_BYTES):
            part = batch.slice(i, j - i)
            yield part, Scan(part.column("text"), part.column("seed").to_numpy(), powers, mask)


def _places(scan: Scan, size: int, parts: BitTable | None, part_size: int) -> np.ndarray:
    """Where sequences of ``size`` words begin whose sequences of ``part_size`` words are all in ``parts``."""
    open_at = scan.starts(size)
    if parts is None or not len(open_at):
        return np.flatnonzero(open_at)
    every = np.flatnonzero(scan.starts(part_size))
    known = np.zeros(len(scan.codes), dtype=bool)
    known[every] = parts.has(scan.prints(part_size, every))
    for shift in range(size - part_size + 1):
        open_at = open_at & known[shift : shift + len(open_at)]
    return np.flatnonzero(open_at)


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, count)`` of each distinct pair of fingerprints; ``index`` is the place of one of its rows."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
    if (~new[1:] & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    begin = np.flatnonzero(new)
    return order[begin], np.diff(np.append(begin, len(a)))


PRINTS = "size int, fp bigint, tag bigint, n bigint"
# A tag is 31 bits of the second fingerprint and 32 bits of the hash of a text.
TAG_DOC = 32


def _tags(second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tags of sequences with these second fingerprints in texts with these hashes."""
    return (_short(second) << TAG_DOC) | (doc & ((1 << TAG_DOC) - 1))


def _short(second: np.ndarray) -> np.ndarray:
    return (second >> np.uint64(33)).view(np.int64)


def _frequent(docs: DataFrame, sizes: Sequence[int], parts: BitTable | None, least: int, mask: int) -> DataFrame:
    """``(size, fp, low, high, n, doc)``, with the least and greatest second fingerprint and a text's hash, of all sequences of these sizes that occur ``least`` times; with size 1 also the
    number of words per language, as size 0."""
    part_size = min(sizes) - 1

    def scan_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scan in _batches(batches, mask):
            docs_of = part.column("doc").to_numpy()

            def rows(size, at, first, second):
                index, counts = _counted(first, second)
                tags = _tags(second[index], docs_of[scan.doc[at[index]]])
                columns = [np.full(len(index), size, np.int32), first[index].view(np.int64), tags, counts]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "fp", "tag", "n"])

            for size in sizes:
                at = _places(scan, size, parts, part_size)
                if not len(at):
                    continue
                yield rows(size, at, scan.prints(size, at), scan.prints(size, at, True))
                if size == 1:
                    yield rows(0, at, scan.seeds, scan.seeds)

    found = docs.select("text", "seed", "doc").mapInArrow(scan_task, PRINTS)
    sums = found.groupBy("size", "fp").agg(F.min("tag").alias("first"), F.max("tag").alias("last"), F.sum("n").alias("n"))
    kept = sums.filter((F.col("n") >= least) | (F.col("size") == 0))
    second = lambda c: F.shiftright(c, TAG_DOC)
    return saved(kept.select("size", "fp", second("first").alias("low"), second("last").alias("high"), "n", _doc(F.col("first")).alias("doc")), "phrase-prints")


def _doc(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << TAG_DOC) - 1))


WORDS = "lang string, size int, phrase string, fp bigint, n bigint"


def _spelled(docs: DataFrame, prints: DataFrame, mask: int) -> DataFrame:
    """``(lang, size, phrase, n)`` of fingerprints that stand for one sequence each, read from the texts they point to.

    The pointer is the least hash of a text, so few texts serve most sequences. Texts may share it: what one spells is
    fingerprinted again before it is believed.
    """
    wanted = prints.groupBy("doc").agg(F.collect_list(F.struct("size", "fp", "low", "n")).alias("wanted"))
    few = prints.select("doc").distinct().limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    keys = prints.select("doc").distinct()
    # Copies of a text are one text.
    held = docs.join(F.broadcast(keys) if few else keys, "doc", "left_semi").groupBy("doc", "seed", "lang", "text").agg(F.lit(0).alias("_one"))
    pairs = held.join(wanted, "doc").select("lang", "text", "seed", "wanted")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                scan = Scan(row.column("text"), row.column("seed").to_numpy(), powers, mask)
                lang, out = row.column("lang")[0].as_py(), []
                asked = row.column("wanted").flatten()
                sizes, fps, lows, counts = (asked.field(k).to_numpy() for k in range(4))
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(scan.starts(size))
                    first, place = np.unique(scan.prints(size, at), return_index=True)
                    mine = np.flatnonzero(sizes == size)
                    where = np.searchsorted(first, fps[mine].view(np.uint64))
                    for j, w in zip(mine.tolist(), where.tolist()):
                        if w < len(first) and first[w] == fps[j].view(np.uint64):
                            begin = at[place[w] : place[w] + 1]
                            if _short(scan.prints(size, begin, True))[0] == lows[j]:
                                out.append((lang, size, scan.phrase(int(begin[0]), size), int(fps[j]), int(counts[j])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                        ["lang", "size", "phrase", "fp", "n"],
                    )

    spelled = pairs.mapInArrow(spell, WORDS)
    return spelled.groupBy("lang", "size", "phrase").agg(F.max("n").alias("n"))


def _recounted(docs: DataFrame, prints: DataFrame, least: int, mask: int) -> DataFrame:
    """``(lang, size, phrase, n)`` behind fingerprints that stand for several sequences, counted by their words."""
    keys = prints.select("size", "fp")
    parts = bit_table(keys, "fp", prints.count())
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scan in _batches(batches, mask):
            langs = part.column("lang").to_pylist()
            for size in sizes:
                at = np.flatnonzero(scan.starts(size))
                first = scan.prints(size, at)
                kept = parts.has(first)
                at, first = at[kept], first[kept]
                index, counts = _counted(first, scan.prints(size, at, True))
                if len(index):
                    begin = at[index].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([langs[d] for d in scan.doc[begin].tolist()], pa.string()), pa.array(np.full(len(begin), size, np.int32)),
                            pa.array([scan.phrase(b, size) for b in begin], pa.string()), pa.array(first[index].view(np.int64)), pa.array(counts),
                        ],
                        ["lang", "size", "phrase", "fp", "n"],
                    )

    seen = docs.select("text", "seed", "lang").mapInArrow(occurrences, WORDS)
    counted = seen.groupBy("lang", "size", "phrase", "fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted.join(keys, ["size", "fp"], "left_semi").select("lang", "size", "phrase", "n")


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = LONGEST, mask: int = (1 << 64) - 1) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``(lang, size, phrase, n)`` of every sequence of 1 to ``longest`` words that occurs ``least``
    times in a language, and ``(lang, total)``, the language's words.

    Counts are exact and cover whole texts. Null texts count as empty, null languages as ``und``; columns other than
    these two are not read, so their names cannot clash. An empty table gives empty results. Copies of rows count again.
    """
    tongue, body = F.coalesce(col(lang), F.lit(NO_LANG)), F.coalesce(col(text), F.lit(""))
    docs = df.select(tongue.alias("lang"), body.alias("text")).select("lang", "text", F.xxhash64("lang").alias("seed"), _doc(F.xxhash64("lang", "text")).alias("doc"))
    levels = [_frequent(docs, [1], None, least, mask)]
    single = levels[0].filter("size = 1")
    if longest > 1:
        levels.append(_frequent(docs, [2], bit_table(single, "fp", single.count()), least, mask))
    if longest > 2:
        levels.append(_frequent(docs, range(3, longest + 1), bit_table(levels[1], "fp", levels[1].count()), least, mask))
    every = levels[0].filter("size > 0")
    for level in levels[1:]:
        every = every.unionByName(level)
    plain, mixed = every.filter("low = high"), every.filter("low <> high")
    phrases = _spelled(docs, plain, mask)
    if not mixed.isEmpty():
        phrases = phrases.unionByName(_recounted(docs, mixed, least, mask))
    langs = docs.select("lang", "seed").distinct()
    totals = levels[0].filter("size = 0").select(F.col("fp").alias("seed"), F.col("n").alias("total")).join(langs, "seed").select("lang", "total")
    return saved(phrases, "phrases"), saved(totals, "phrase-totals")


def _words(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, scale: int = 1000, share: int = 100, longest: int = LONGEST, mask: int = (1 << 64) - 1) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``a`` occurrences, ``l`` and ``r`` those of the two parts at the weakest cut, ``n`` the language's words, ``score`` =
    ``scale * a * n / (l * r)``, rounded down in exact arithmetic. Ties between cuts go to the earliest one. A phrase inside a longer one that
    has at least ``share`` percent of its occurrences is dropped; a chain of such phrases always passes through the one that
    is a word longer, so that one decides. Nulls, copies and empty tables: see ``frequent_phrases``. Ties in score go to the
    greater ``a``, then to the lesser phrase by bytes.
    """
    phrases, totals = frequent_phrases(df, text, lang, least, longest, mask)
    wide = phrases.filter("size > 1")
    ends = F.explode(F.array(F.lit(1), F.lit(2))).alias("from")
    inner = wide.filter("size > 2").select("lang", "size", "phrase", "n", ends).select("lang", _words(F.col("phrase"), F.col("from"), F.col("size") - 1).alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = wide.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    lefts = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # A table with a row per language, which the counts bound.
    sized = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals.withColumnRenamed("total", "n"), "lang")
    number = lambda c: F.col(c).cast("decimal(19,0)")
    above = (number("a") * number("n")).cast("decimal(34,0)") * F.lit(scale).cast("decimal(4,0)")
    score = F.call_function("div", above.cast("decimal(38,0)"), (number("l") * number("r")).cast("decimal(38,0)"))
    scored = sized.withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    rows = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))
    # A language may hold most phrases: its parts are ranked apart, and only their leaders meet.
    leaders = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
