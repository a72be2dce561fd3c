from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabweave.llm import packing as pk


def cost(sizes, lengths, overhead=16):
    bins, offsets, final = pk.pack_pieces(sorted(sizes, reverse=True), lengths, overhead)
    used = defaultdict(int)
    for size, b, offset in zip(sorted(sizes, reverse=True), bins, offsets):
        assert offset == used[b]
        used[b] += size
    for b, length in enumerate(final):
        assert used[b] <= length and not any(used[b] <= x < length for x in lengths)
    return sum(c + overhead for c in final)


def best(sizes, lengths, overhead=16):
    """The cheapest packing, by trying every split into groups."""
    sizes = tuple(sizes)
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    found = float("inf")
    for n in range(len(rest) + 1):
        for mates in itertools.combinations(range(len(rest)), n):
            total = first + sum(rest[i] for i in mates)
            fits = [x for x in lengths if x >= total]
            if fits:
                left = tuple(r for i, r in enumerate(rest) if i not in mates)
                found = min(found, min(fits) + overhead + best(left, lengths, overhead))
    return found


def test_close_to_the_cheapest_packing():
    draw = random.Random(1)
    ratios = []
    for _ in range(30):
        sizes = [draw.randint(1, 16) for _ in range(7)]
        ratios.append(cost(sizes, [8, 12, 16], 1) / best(sizes, [8, 12, 16], 1))
    assert max(ratios) <= 1.35 and sum(ratios) / len(ratios) <= 1.08


def test_little_room_is_left():
    draw = random.Random(2)
    sizes = [min(8192, int(draw.paretovariate(0.9) * 60)) for _ in range(4000)]
    whole = sum(sizes)
    spent = cost(sizes, pk.LENGTHS)
    assert spent <= 1.02 * whole + 16 * len(sizes)
    bins, _, final = pk.pack_pieces(sorted(sizes, reverse=True))
    assert sum(final) <= 1.01 * whole + 8192


def test_several_lengths_beat_one():
    draw = random.Random(3)
    sizes = [draw.choice([500, 900, 3000, 5000]) for _ in range(300)]
    assert cost(sizes, pk.LENGTHS) <= cost(sizes, [8192])


def test_equal_sizes_share_bins():
    bins, _, final = pk.pack_pieces([512] * 32)
    assert sum(final) == 512 * 32 and len(set(bins)) == len(final)


def checked(rows, out, lengths=pk.LENGTHS):
    tokens = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        tokens[r.doc_id].append((r.first_token, r.n_tokens))
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_length))
    for parts in bins.values():
        parts.sort()
        length = {p[2] for p in parts}
        assert len(length) == 1 and length <= set(lengths)
        at = 0
        for offset, n, _ in parts:
            assert offset == at
            at += n
        assert at <= length.pop()
    return tokens


def test_every_token_has_one_place(spark):
    rows = [(i, "word, " * (i * 37 % 900)) for i in range(300)] + [(900, "a " * 30_000), (901, None), (902, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, shard int, piece int").repartition(3)
    tokens = checked(rows, pk.pack_documents(df, shard_tokens=60_000).collect())
    assert set(tokens) == {r[0] for r in rows}
    for doc, text in rows:
        at = 0
        for first, n in sorted(tokens[doc]):
            assert first == at
            at += n
        assert at == 1 + (text or "").count("word") * 2 + (text or "").count("a ")


def test_repeated_rows_and_keys(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], "doc_id bigint, text string")
    out = pk.pack_documents(df).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens) for r in out) == [(-1, 2), (1, 3), (1, 3), (1, 3)]
    assert pk.pack_documents(df.limit(0)).count() == 0
    own = pk.pack_documents(df, tokens=F.lit(100), lengths=[64, 128]).collect()
    assert all(r.n_tokens == 100 or r.n_tokens in (64, 36) for r in own)
    assert pk.pack_documents(df, tokens=F.lit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    from tabweave.llm.queries import op3_packing

    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r[0]: r[1] for r in docs.select("doc_id", pk.token_count(F.col("text"))).collect()}
    out = op3_packing(spark, folder).collect()
    tokens = checked(None, out)
    assert {d: sum(n for _, n in parts) for d, parts in tokens.items()} == want
    lengths = {r.bin_id: r.bin_length for r in out}
    assert sum(want.values()) >= 0.9 * sum(lengths.values())


def test_a_new_bin_is_filled_in_thought_with_many_sizes():
    from tabweave.llm.packing import Waiting

    sizes = list(range(300, 340))
    total = 0
    for size in sorted(sizes, reverse=True):
        total += size if total + size <= 8192 else 0
    assert Waiting(sizes).filled(8192) == total > 16 * 340
