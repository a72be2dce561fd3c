"""Rows in ascending order of an integer id, cut into ranges that are sorted each in its own task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import col

RANGE_BYTES = 32_000_000
# Ranges grow beyond RANGE_BYTES rather than become more than this; they are streamed, so a longer one only takes longer.
MOST_RANGES = 100_000
SAMPLES_PER_RANGE = 20


@dataclass(frozen=True)
class Cuts:
    """Lower ends of ranges as ``(id, tie)`` pairs in ascending order; rows without an id come before all ids."""

    known: np.ndarray
    ids: np.ndarray
    ties: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def places(self, known: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """How many cuts are at or below each row."""
        cut = len(self.known) - int(self.known.sum())
        out = np.empty(len(ids), dtype=np.int32)
        out[known] = cut + _pair_places(self.ids[cut:], self.ties[cut:], ids[known], ties[known])
        out[~known] = np.searchsorted(self.ties[:cut], ties[~known], side="right")
        return out


def _pair_places(cut_ids: np.ndarray, cut_ties: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    first, last = np.searchsorted(cut_ids, ids, side="left"), np.searchsorted(cut_ids, ids, side="right")
    out = first.copy()
    # Only rows that share their id with a cut are compared by their ties.
    for start in np.unique(first[first < last]).tolist():
        mine = np.flatnonzero((first == start) & (last > start))
        out[mine] = start + np.searchsorted(cut_ties[start : last[mine[0]]], ties[mine], side="right")
    return out


def id_cuts(df: DataFrame, key: str, text: str, tie: str) -> Cuts:
    """Ranges of nearly equal row counts, from sampled ``(key, tie)`` pairs; any cuts give a right order.

    Ties spread rows that share an id, or have none. The number of ranges follows the bytes of ``text`` and is at least the
    number of shuffle partitions; the driver holds a bounded sample of numbers.
    """
    size = df.agg(F.sum(F.octet_length(col(text)).cast("bigint")), F.count("*")).first()
    total, rows = size[0] or 0, size[1]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-total // RANGE_BYTES)))
    pairs = df.select(col(key).cast("bigint").alias("id"), col(tie).alias("tie"))
    share = min(1.0, SAMPLES_PER_RANGE * parts / max(1, rows))
    drawn = pairs.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "tie").sample(share, seed=7).toPandas()
    drawn = drawn.astype({"known": bool, "id": np.int64, "tie": np.int64}).sort_values(["known", "id", "tie"])
    if not len(drawn) or parts == 1:
        drawn = drawn[:0]
    else:
        drawn = drawn.iloc[np.unique(len(drawn) * np.arange(1, parts) // parts)].drop_duplicates()
    return Cuts(*(drawn[c].to_numpy() for c in ("known", "id", "tie")))


def in_ranges(df: DataFrame, key: str, tie: str, cuts: Cuts, name: str) -> DataFrame:
    """``name``: the range of each row, from 0. The cuts go to the workers as a broadcast of bounded size."""
    held = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def place(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(held.value.places(known.to_numpy(bool), ids.to_numpy(np.int64), ties.to_numpy(np.int64)))

    id_ = col(key).cast("bigint")
    return df.withColumn(name, place(id_.isNotNull(), F.coalesce(id_, F.lit(0)), col(tie)))


def sorted_ranges(df: DataFrame, name: str, parts: int, order: list) -> DataFrame:
    """One task per range, sorted by ``order``."""
    return df.repartitionById(parts, F.col(name)).sortWithinPartitions(*order)
