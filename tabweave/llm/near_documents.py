"""Near-duplicate documents by BagMinHash: signatures of shingle multisets, bands, and verified overlap.

The weight of a shingle is its number of occurrences. Its weight axis is cut into the dyadic intervals [0, 1), [1, 2),
[2, 4), [4, 8) ...; each has a Poisson process over time with its length as rate, whose points carry a signature slot
and a place in the interval. A point counts for a document if its place is below the shingle's weight there. The
earliest point of each slot is the signature: two documents agree in a slot with the probability of their weighted
Jaccard similarity, the sum of the smaller weights over the sum of the larger. Points later than the latest filled slot
are never drawn, so long documents need hardly more than one point per shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import WordHashes, col, components, discard, mix, saved, shingle_hashes, slices, word_hashes

# 28 bands of 5 slots miss a pair at similarity 0.8 with a probability of (1 - 0.8 ** 5) ** 28, one in 68,000.
BANDS = 28
BAND_SLOTS = 5
SLOTS = BANDS * BAND_SLOTS
# Characters of text whose signatures are built together, at least one document.
BATCH_CHARS = 1_000_000
# Members compared with one leader in one task.
LEADER_GROUP = 256
STAR_ROUNDS = 3
# Members of each side of a block.
BLOCK_MEMBERS = 512
# Members of small buckets in one call.
BATCH_MEMBERS = 2_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def multiset(text: str | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text, memo)), return_counts=True)


def node_of(text: str | None, hashes: np.ndarray, weights: np.ndarray) -> int:
    """The number of a multiset: documents with equal multisets are copies and share it. Texts without words share it if they are equal."""
    if len(hashes):
        held = hashes.tobytes() + weights.astype("<i8").tobytes()
    else:
        held = b"null" if text is None else b"text" + text.encode("utf-8", "surrogatepass")
    digest = hashlib.md5(held).digest()
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of ``SLOTS`` arrival times per multiset; rows of empty ones stay infinite."""
    sizes = [len(h) for h, _ in sets]
    doc = np.repeat(np.arange(len(sets)), sizes)
    if not len(doc):
        return np.full((len(sets), SLOTS), np.inf)
    hashes = np.concatenate([h for h, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(np.int64)
    # One stream per shingle and dyadic interval below its weight.
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 2))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.where(level > 0, low, 1).astype(float)
    doc, limit = doc[which], weights[which]
    with np.errstate(over="ignore"):
        state = mix(hashes[which] + level.astype(np.uint64) * GOLDEN)
        time = np.zeros(len(which))
        out = np.full(len(sets) * SLOTS, np.inf)
        latest = np.full(len(sets), np.inf)
        turn = 0
        while len(state):
            state = state + GOLDEN
            drawn = mix(state)
            time = time - np.log1p(-(drawn >> np.uint64(11)).astype(float) * 2.0**-53) / length
            drawn = mix(drawn + GOLDEN)
            slot = (drawn >> np.uint64(32)) % np.uint64(SLOTS)
            place = low + ((drawn & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * length).astype(np.int64)
            counts = place < limit
            np.minimum.at(out, doc[counts] * SLOTS + slot[counts].astype(np.int64), time[counts])
            turn += 1
            if turn < 8 or turn % 8 == 0:
                latest = out.reshape(-1, SLOTS).max(axis=1)
            go = time < latest[doc]
            if not go.all():
                state, time, doc, low, length, limit = (x[go] for x in (state, time, doc, low, length, limit))
    return out.reshape(-1, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band. Times are rounded to single precision first, so that the last bits do not count."""
    bits = signature.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, BAND_SLOTS)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), bits.shape[:2]).copy()
        for i in range(BAND_SLOTS):
            keys = mix((keys + bits[:, :, i]) * GOLDEN)
    return keys.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 1 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 1.0


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = WordHashes()
    for batch in batches:
        for i, j in slices(batch["text"].map(lambda t: len(t or "")).to_numpy(), BATCH_CHARS):
            part = batch.iloc[i:j]
            sets = [multiset(t, memo) for t in part["text"]]
            keys = band_keys(signatures(sets))
            yield pd.DataFrame({
                "id": part["id"],
                "node": [node_of(t, *s) for t, s in zip(part["text"], sets)],
                "shingles": [int(s[1].sum()) for s in sets],
                "keys": [k if len(s[0]) else k[:0] for k, s in zip(keys, sets)],
            })


def _payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = WordHashes()
    for batch in batches:
        for i, j in slices(batch["text"].map(lambda t: len(t or "")).to_numpy(), BATCH_CHARS):
            part = batch.iloc[i:j]
            sets = [multiset(t, memo) for t in part["text"]]
            # Of documents that share an id, only the one whose multiset is asked for counts.
            rows = [(n, *_packed(*s)) for n, t, s in zip(part["node"], part["text"], sets) if node_of(t, *s) == n]
            yield pd.DataFrame(rows, columns=["node", "hashes", "extra"])


def _packed(hashes: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    many = np.flatnonzero(weights > 1)
    return hashes.tobytes(), np.stack((many, weights[many])).astype("<i8").tobytes()


def _unpacked(hashes: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(hashes, dtype=np.uint64)
    weights = np.ones(len(values), dtype=np.int64)
    places, counts = np.frombuffer(extra, dtype="<i8").reshape(2, -1)
    weights[places] = counts
    return values, weights


def _verified(pairs: DataFrame, payload: DataFrame, least: float) -> DataFrame:
    """Pairs ``(u, v)`` whose multisets overlap by ``least`` or more. A popular ``v`` is sent to several tasks, each with
    at most about ``LEADER_GROUP`` partners."""
    groups = pairs.groupBy("v").agg(F.ceil(F.count("*") / LEADER_GROUP).alias("groups"))
    dealt = pairs.join(groups, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("groups")).cast("int").alias("group"))
    members = dealt.join(payload, F.col("u") == F.col("node")).select("v", "group", "node", "hashes", "extra")
    leaders = groups.select("v", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("group"))
    leaders = leaders.join(payload, F.col("v") == F.col("node")).select("v", "group", "node", "hashes", "extra")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        leader, out, v = None, [], int(rows["v"].iloc[0])
        for node, hashes, extra in zip(rows["node"], rows["hashes"], rows["extra"]):
            if node == v:
                leader = _unpacked(hashes, extra)
        if leader is not None:
            for node, hashes, extra in zip(rows["node"], rows["hashes"], rows["extra"]):
                if node != v and overlap(leader, _unpacked(hashes, extra)) >= least:
                    out.append((node, v))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return members.unionByName(leaders).groupBy("v", "group").applyInPandas(check, "u bigint, v bigint")


def _in_components(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of buckets that hold several components still, with their component."""
    roots = components(edges, "document-components")
    tagged = members.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    return tagged.join(mixed, "key")


def near_documents(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """``(key, class_id, group_id, n_copies, kept)`` for every row with a key.

    Words are chunks between white space in lower case, without punctuation at their ends (a chunk of nothing else is a word
    as it is); shingles are runs of five (all words of a shorter text). Documents with equal shingle multisets are copies
    and share ``class_id``, the smallest key among them; null, empty and blank texts are copies of equal ones only. Classes are linked if they share a band and their weighted Jaccard
    similarity is ``least`` or more. ``group_id`` is the smallest key that links reach, ``n_copies`` the size of the
    class, and ``kept`` marks the one row of the group to stay. Repeated rows are copies: of rows that share the
    smallest key, every one is marked. Rows without a key are left out. Keys are integers. Other columns are left out.

    In a bucket all members are first compared with one leader, then with another; what that joins needs no further
    comparison. Members of different components that still share a bucket are then compared with each other in blocks, so
    no link between components is lost, and what a leader joins costs one comparison per member and round.
    """
    docs = df.select(col(key).cast("bigint").alias("id"), col(text).alias("text")).filter("id IS NOT NULL")
    signed = saved(docs.mapInPandas(_signed, "id bigint, node bigint, shingles bigint, keys array<bigint>"), "signatures")
    classes = signed.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    edges = _edges(docs, signed, least)
    roots = components(edges, "document-components")
    classes = classes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return (
        signed.select("id", "node")
        .join(classes.join(groups, "component").select("node", "class_id", "n_copies", "group_id"), "node")
        .select(F.col("id").alias(key), "class_id", "group_id", "n_copies", (F.col("id") == F.col("group_id")).alias("kept"))
    )


def _edges(docs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    banded = signed.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = saved(banded.join(shared, "key"), "buckets")
    wanted = members.select("node").distinct()
    # One document stands for each class that shares a bucket.
    stands = signed.join(wanted, "node").groupBy("node").agg(F.min("id").alias("id"))
    payload = saved(docs.join(stands, "id").select("text", "node").mapInPandas(_payloads, "node bigint, hashes binary, extra binary").dropDuplicates(["node"]), "shingles")
    edges, left = None, members.withColumn("component", F.col("node"))
    for turn in range(STAR_ROUNDS):
        order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "component")
        leaders = left.groupBy("key").agg(F.min(order).alias("leader"))
        pairs = left.join(leaders, "key").filter("component <> leader.component")
        pairs = pairs.select(F.greatest("node", "leader.node").alias("hi"), F.least("node", "leader.node").alias("lo"), F.col("leader.node").alias("v"), F.col("node").alias("u"))
        # A pair may be met from both sides.
        pairs = pairs.groupBy("hi", "lo").agg(F.min("v").alias("v")).select(F.when(F.col("v") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("u"), "v")
        found = saved(_verified(pairs, payload, least), "edges")
        edges = found if edges is None else edges.unionByName(found)
        following = saved(_in_components(members, edges), "buckets")
        if turn:
            discard(left)
        left = following
    return edges.unionByName(_left_links(left, signed, payload, least))


def _left_links(left: DataFrame, signed: DataFrame, payload: DataFrame, least: float) -> DataFrame:
    """Links between components that still share a bucket, ``left`` as ``(key, node, component)``.

    In each bucket the members outside of its largest component meet each other and those inside, in blocks; a block
    compares its members in place and gives one edge per pair of components it joins. A pair that shares several bands
    is compared in the first of them only.
    """
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    blocks = largest.select(
        "key",
        F.col("top.component").alias("major"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK_MEMBERS).cast("int").alias("minors"),
        F.ceil(F.col("top.n") / BLOCK_MEMBERS).cast("int").alias("majors"),
    )
    placed = left.join(blocks, "key").withColumn("minor", F.col("component") != F.col("major"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda a, b, inside: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(inside).alias("inside"))
    own = F.col("block")
    tasks = F.when(
        F.col("minor"),
        F.concat(
            F.transform(span(F.col("minors")), lambda i: task(F.least(own, i), F.greatest(own, i), True)),
            F.transform(span(F.col("majors")), lambda i: task(own, i, False)),
        ),
    ).otherwise(F.transform(span(F.col("minors")), lambda i: task(i, own, False)))
    # Buckets of one block each are compared many at a time, which spares a call for each of very many small ones.
    batches = max(1, left.count() // BATCH_MEMBERS)
    small = (F.col("minors") == 1) & (F.col("majors") == 1)
    batch = F.when(small, F.pmod(F.xxhash64("key"), F.lit(batches))).otherwise(F.col("key"))
    sent = placed.select(batch.alias("batch"), "key", "node", "component", "minor", "block", F.explode(tasks).alias("task"))
    # A class's keys and shingles are the same in all of its documents.
    nodes = left.select("node").distinct()
    known = signed.join(nodes, "node").dropDuplicates(["node"]).select("node", "keys").join(payload, "node")
    rows = sent.join(saved(known, "left-members"), "node").select(
        "batch", "key", F.col("task.a").alias("a"), F.col("task.b").alias("b"), F.col("task.inside").alias("inside"),
        "node", "component", "minor", "block", "keys", "hashes", "extra",
    )

    def compare(name, group: pd.DataFrame) -> pd.DataFrame:
        _, a, b, inside = name
        order = np.argsort(group["key"].to_numpy(), kind="stable")
        columns = {c: group[c].to_numpy()[order] for c in ("key", "node", "component", "minor", "block", "keys", "hashes", "extra")}
        ends = np.append(np.flatnonzero(np.diff(columns["key"])) + 1, len(order))
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out, start = [], 0
        for end in ends.tolist():
            places = np.arange(start, end)
            minor, block = columns["minor"][start:end], columns["block"][start:end]
            if inside:
                mine, theirs = places[minor & (block == a)], places[minor & (block == b)]
            else:
                mine, theirs = places[minor], places[~minor]
            if len(mine) and len(theirs):
                out += _joining(columns, mine, theirs, bool(inside) and a == b, least, sets)
            start = end
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return rows.groupBy("batch", "a", "b", "inside").applyInPandas(compare, "u bigint, v bigint")


def _joining(columns: dict, mine: np.ndarray, theirs: np.ndarray, same: bool, least: float, sets: dict) -> list[tuple[int, int]]:
    """Pairs of nodes of one bucket whose links join components; a pair that shares an earlier band is left to that.

    ``sets`` remembers the multisets of the nodes of a task.
    """

    def opened(at: int) -> tuple[np.ndarray, np.ndarray]:
        node = columns["node"][at]
        if node not in sets:
            sets[node] = _unpacked(columns["hashes"][at], columns["extra"][at])
        return sets[node]

    key = columns["key"][mine[0]]
    left_keys, right_keys = np.stack(columns["keys"][mine]), np.stack(columns["keys"][theirs])
    band = int(np.flatnonzero(left_keys[0] == key)[0])
    left_of, right_of = columns["component"][mine].astype(np.int64), columns["component"][theirs].astype(np.int64)
    right_sizes = np.array([opened(j)[1].sum() for j in theirs])
    out = []
    for i, at in enumerate(mine.tolist()):
        own = opened(at)
        size = own[1].sum()
        # An overlap cannot exceed the ratio of the sizes.
        waiting = (np.minimum(right_sizes, size) >= least * np.maximum(right_sizes, size)) & (right_of != left_of[i])
        if same:
            waiting[: i + 1] = False
        if waiting.any() and band:
            waiting &= ~(right_keys[:, :band] == left_keys[i, :band]).any(axis=1)
        while waiting.any():
            j = int(waiting.argmax())
            waiting[j] = False
            if overlap(own, opened(theirs[j])) >= least:
                out.append((int(columns["node"][at]), int(columns["node"][theirs[j]])))
                joined, into = right_of[j], left_of[i]
                right_of[right_of == joined] = into
                left_of[left_of == joined] = into
                waiting &= right_of != into
    return out


def drop_near_documents(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one document of each group of ``near_documents`` stays, that with the
    smallest key. Of several rows with that key one stays. Rows without a key stay."""
    groups = near_documents(df, key, text, least)
    kept = groups.filter("kept").select(F.col(key).alias("_kept")).distinct()
    # Rows travel as one struct, so that no column of theirs can clash.
    rows = df.select(F.struct(*[col(c).alias(c) for c in df.columns]).alias("_row"), col(key).cast("bigint").alias("_id"))
    named = rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").dropDuplicates(["_id"])
    return named.select("_row.*").unionByName(rows.filter("_id IS NULL").select("_row.*"))
