"""Document fingerprints: every shingle hash below a fixed share of the hash range.

A fingerprint is a set of hashes, so that of a union of shingles is the union of fingerprints below the threshold, and
containment can be estimated between texts of very different lengths: both are compared on the same part of the range.
Short texts, of which few hashes fall below the threshold, keep their smallest hashes up to a floor; two fingerprints are
then compared up to the lower of their own thresholds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import col, mix
from tabweave.llm.ordered import id_cuts, in_ranges, sorted_ranges

SHINGLE_CHARS = 16
# Share of the hash range that is kept, as a power of two: one in 2 ** SHARE_BITS.
SHARE_BITS = 4
HASH_BITS = 42
HASH_CHARS = 7
# A text with at least as many shingles keeps this many hashes at least.
FLOOR = 16

DIGITS = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)
VALUES = np.zeros(256, dtype=np.uint64)
VALUES[DIGITS] = np.arange(64, dtype=np.uint64)
SHIFTS = np.arange(6 * (HASH_CHARS - 1), -1, -6, dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def char_shingles(points: np.ndarray) -> np.ndarray:
    """Hash of every run of ``SHINGLE_CHARS`` code points; of the whole text if it is shorter, none if it is empty.

    Runs are built by doubling: a run of 2k code points from the two runs of k.
    """
    if not len(points):
        return np.zeros(0, dtype=np.uint64)
    hashes = points.astype(np.uint64) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    if len(points) < SHINGLE_CHARS:
        total = np.zeros(1, dtype=np.uint64)
        for value in hashes:
            total = total * base + value
        return mix(total + np.uint64(len(points))) >> np.uint64(64 - HASH_BITS)
    width = 1
    with np.errstate(over="ignore"):
        while width < SHINGLE_CHARS:
            hashes = hashes[:-width] * base + hashes[width:]
            base, width = base * base, width * 2
    return mix(hashes) >> np.uint64(64 - HASH_BITS)


def sketch(points: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a fingerprint."""
    hashes = char_shingles(points)
    kept = np.unique(hashes[hashes < np.uint64(1 << (HASH_BITS - SHARE_BITS))])
    return kept if len(kept) >= FLOOR else np.unique(hashes)[:FLOOR]


def to_text(hashes: np.ndarray) -> str:
    """Hashes in ascending order, each in seven digits of base 64 that sort like the numbers."""
    return DIGITS[((hashes[:, None] >> SHIFTS) & np.uint64(63)).astype(np.intp)].tobytes().decode()


def from_text(text: str) -> np.ndarray:
    digits = VALUES[np.frombuffer(text.encode(), dtype=np.uint8).reshape(-1, HASH_CHARS)]
    return (digits << SHIFTS).sum(axis=1, dtype=np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of the smaller text that the other has; 1 for equal sketches, 0 if one is empty."""
    if np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    share = np.uint64((1 << (HASH_BITS - SHARE_BITS)) - 1)
    # A sketch that reached past the share covers the range up to its last hash if it is full, all of it if it is not.
    reach = min(_reach(a, share), _reach(b, share))
    a, b = a[a <= reach], b[b <= reach]
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 0.0


def _reach(hashes: np.ndarray, share: np.uint64) -> np.uint64:
    if len(hashes) < FLOOR:
        return np.uint64((1 << HASH_BITS) - 1)
    return max(hashes[-1], share)


def fingerprint_texts(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of the whole text; null and empty texts have an empty one.

    Nothing is shuffled; a row needs memory for its own text only. A column called like ``name`` is replaced.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(sketch(code_points(t or ""))))

    return df.withColumn(name, run(col(text)))


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited copy, and their likeness to each other and to the next text.

    The edit replaces the last quarter of the code points (rounded down) by as many (or all) first ones of the next
    document in the order of ``key``; the last document is followed by the first. Null ids come first; documents that
    share an id are ordered by a hash of their text. A single document is its own next one. Null texts count as empty.
    Other columns are left out.

    Texts are shuffled once, into ranges of ids; the first document of each range is also sent to the range before.
    """
    rows = df.select(col(key).cast("bigint").alias("key"), F.coalesce(col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = id_cuts(rows, "key", "text", "tie")
    parts = len(cuts) + 1
    rows = in_ranges(rows, "key", "tie", cuts, "part")
    known, id_ = F.col("key").isNotNull(), F.coalesce("key", F.lit(0))
    firsts = rows.groupBy("part").agg(F.min(F.struct(known.alias("known"), id_.alias("id"), "tie")).alias("first"))
    # A range's first document is a copy at the end of the filled range before; that of the first range goes to the last.
    # One row per range, of which there is a bounded number.
    order = Window.orderBy("part")
    last = F.max("part").over(Window.partitionBy())
    sent = F.broadcast(firsts.select(
        F.col("first.known").alias("_known"), F.col("first.id").alias("_id"), F.col("first.tie").alias("_tie"), F.coalesce(F.lag("part").over(order), last).alias("to"),
    ))
    met = (known == F.col("_known")) & (id_ == F.col("_id")) & (F.col("tie") == F.col("_tie"))
    copies = rows.join(sent, met).select("key", "text", "tie", F.col("to").alias("part"), F.lit(1).alias("copy"))
    # Rows that equal the first one in every way are all copied; the reader stops at the first.
    both = rows.select("key", "text", "tie", "part", F.lit(0).alias("copy")).unionByName(copies)
    ordered = sorted_ranges(both, "part", parts, ["copy", F.asc_nulls_first("key"), "tie"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        ended = False
        for batch in batches:
            out = []
            for id_, value, copy in zip(batch["key"], batch["text"], batch["copy"]):
                if ended:
                    break
                points = code_points(value)
                own = sketch(points)
                if before is not None:
                    out.append(_edited(*before, points, own))
                before = (None if pd.isna(id_) else int(id_), value, points, own)
                ended = bool(copy)
            if out:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"key": "Int64"})

    kinds = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("key", "text", "copy").mapInPandas(run, kinds).withColumnRenamed("key", key)


COLUMNS = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited(id_, value: str, points: np.ndarray, own: np.ndarray, next_points: np.ndarray, next_sketch: np.ndarray) -> tuple:
    cut = len(points) // 4
    edited = np.concatenate((points[: len(points) - cut], next_points[:cut]))
    changed = sketch(edited)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
    return (
        id_, len(points), digest.hexdigest(), to_text(own), to_text(changed),
        likeness(own, changed), likeness(own, next_sketch),
    )
