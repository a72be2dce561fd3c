"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt to shards by a hash; each shard is packed alone, longest pieces first. A piece goes to the open bin
that it leaves the least room in. If none has room, a bin is opened, of the permitted length that costs least per token:
for each length the room behind the piece is filled, in thought, with the longest waiting pieces that fit. At the end
each bin is cut down to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import col

LENGTHS = (512, 1024, 2048, 4096, 8192)
# Cost of a sequence besides its tokens, in tokens.
OVERHEAD = 16
# Tokens and rows a shard should hold.
SHARD_TOKENS = 40_000_000
SHARD_ROWS = 400_000


class Waiting:
    """How many pieces of each length have not been placed yet."""

    def __init__(self, sizes: Sequence[int]):
        values, counts = np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
        self.values, self.left = values.tolist(), dict(zip(values.tolist(), counts.tolist()))

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            del self.left[size]
            self.values.pop(bisect.bisect_left(self.values, size))

    def filled(self, room: int) -> int:
        """Tokens of the longest waiting pieces that fit one after the other.

        Each step goes on to a smaller size, so there are no more of them than different sizes that fit together.
        """
        total, at = 0, len(self.values)
        while total < room:
            at = bisect.bisect_right(self.values, room - total, 0, at) - 1
            if at < 0:
                break
            size = self.values[at]
            total += size * min(self.left[size], (room - total) // size)
        return total


def pack_pieces(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """``(bin of each piece, offset of each piece, length of each bin)``; ``sizes`` fall, none exceeds the longest length."""
    lengths = sorted(lengths)
    waiting = Waiting(sizes)
    # Open bins by their room; rooms in order.
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    bins, offsets, used = [], [], []
    capacity: list[int] = []
    for size in sizes:
        waiting.take(size)
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            place = stack.pop()
            if not stack:
                del by_room[room]
                rooms.pop(at)
        else:
            place = len(used)
            used.append(0)
            fits = [c for c in lengths if c >= size]
            capacity.append(min(fits, key=lambda c: ((c + overhead) / (size + waiting.filled(c - size)), c)))
        bins.append(place)
        offsets.append(used[place])
        used[place] += size
        room = capacity[place] - used[place]
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(place)
    final = [lengths[bisect.bisect_left(lengths, n)] for n in used]
    return bins, offsets, final


def token_count(text: Column) -> Column:
    """Tokens of a text as this operator counts them: words and single marks, and one for the end of the document."""
    pieces = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))
    return pieces.cast("bigint") + 1


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD,
    tokens: Column | None = None, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``(key, piece, first_token, n_tokens, bin_id, bin_length, bin_offset)``: where every token of every row lies.

    A row longer than the longest permitted length is cut into pieces of that length and a rest, each packed like a
    document. ``tokens`` counts the tokens of a row (by default words, marks and an end); null and empty texts have the
    end only, rows without a key are packed as well, repeated rows are packed each. Extra columns are left out. The
    number of shards follows the tokens and is at least the number of shuffle partitions; only sizes are shuffled, not
    texts.
    """
    longest = max(lengths)
    rows = df.select(col(key).cast("bigint").alias("id"), (token_count(col(text)) if tokens is None else tokens.cast("bigint")).alias("total"))
    # Sizes are a few bytes per row, so the count costs one scan; shards are sized by it.
    whole, count = rows.agg(F.sum("total"), F.count("*")).first()
    whole = whole or 0
    # A shard wastes at most part of a few bins, so small tables take few.
    shards = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(whole / 1_000_000)), math.ceil(whole / shard_tokens), math.ceil(count / SHARD_ROWS))
    # Pieces of one very long row may go to different shards.
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("total") - 1), F.lit(longest).cast("bigint"))
    pieces = rows.filter("total > 0").select("id", "total", F.posexplode(starts).alias("piece", "first"))
    pieces = pieces.withColumn("size", F.least(F.lit(longest), F.col("total") - F.col("first")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "total", "piece"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is None or not len(rows):
            return
        for shard, part in rows.groupby("shard", sort=True):
            part = part.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
            bins, offsets, final = pack_pieces(part["size"].tolist(), lengths, overhead)
            place = np.array(bins, dtype=np.int64)
            yield pd.DataFrame({
                "id": part["id"].astype("Int64"), "piece": part["piece"], "first_token": part["first"], "n_tokens": part["size"],
                "bin_id": (int(shard) << 32) + place, "bin_length": np.array(final, dtype=np.int64)[place], "bin_offset": offsets,
            })

    kinds = "id bigint, piece int, first_token bigint, n_tokens bigint, bin_id bigint, bin_length bigint, bin_offset bigint"
    dealt = pieces.select("id", "piece", "first", "size", "shard").repartitionById(shards, F.col("shard"))
    return dealt.mapInPandas(run, kinds).withColumnRenamed("id", key)
