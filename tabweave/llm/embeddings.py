"""Exact near-duplicates among vectors: a metric range join over pivot cells.

On vectors of length one, a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots cut the vectors into
cells by their nearest pivot. By the triangle inequality a vector whose distance to another cell's pivot exceeds that to
its own by more than 2r has no neighbour there, so it is sent only to the other cells. Cells are joined independently,
each in blocks of bounded size; a block gives the links of each vector as numbers and the components inside it as one
edge per vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import col, components, discard, saved

# Vectors a cell should hold, and a block may hold of each side.
CELL_ROWS = 4096
# Bound of the pivots that are broadcast.
MAX_PIVOTS = 1024
# Single-precision products this close to the limit are computed again in double precision.
DOUBT = 1e-4


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow for large components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b``, all of length one, have a product of at least ``least`` in double precision."""
    products = a.astype(np.float32) @ b.astype(np.float32).T
    found = products >= least
    for i, j in zip(*np.nonzero(np.abs(products - np.float32(least)) < DOUBT)):
        found[i, j] = float(a[i] @ b[j]) >= least
    return found


def _roots(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and each column reaches through ``found``, within this block."""
    left, right = left.copy(), right.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(found, right[None, :], far).min(axis=1))
        new_right = np.minimum(right, np.where(found, new_left[:, None], far).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _block(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: float) -> pd.DataFrame:
    """Links and local components of one block; ``same`` says that both sides are the same rows."""
    # Stored vectors may be single precision; lengths and doubtful products need double.
    rows, cols = (unit_rows(np.stack(side["vector"].to_numpy()).astype(float)) for side in (left, right))
    found = np.concatenate([linked(rows[i : i + 1024], cols, least) for i in range(0, len(rows), 1024)])
    ids, others = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
    if same:
        np.fill_diagonal(found, False)
    i, j = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    if not len(i):
        return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
    found = found[np.ix_(i, j)]
    copies, other_copies = left["copies"].to_numpy(np.int64)[i], right["copies"].to_numpy(np.int64)[j]
    root_i, root_j = _roots(found, ids[i], others[j])
    parts = [(ids[i], root_i, found @ other_copies)]
    if not same:
        parts.append((others[j], root_j, copies @ found))
    u, v, n = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"u": u, "v": v, "links": n.astype(np.int64)})


def valid_vector(vector) -> Column:
    """Whether a vector can be compared: some component differs from zero and none is null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_components(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    ``n_links`` counts the other rows with a cosine of at least ``least``, ``component_id`` is the smallest key that links
    reach and ``kept`` marks the row whose key it is. Rows with equal vectors are compared once. Vectors that are null,
    empty, zero or hold null, NaN or infinite components link with nothing, and neither do vectors of different lengths.
    Rows without a key link with nothing and belong to no component. Rows that share a key stay rows of their own, but
    links through one of them reach what links with the others where it is the smallest of its copies. Keys are
    integers. Other columns are left out.

    Pivots are the first keys in hash order, at most ``MAX_PIVOTS`` per length, which only steers the work.
    """
    kind = "double" if "double" in dict(df.dtypes)[vector] else "float"
    rows = df.select(col(key).cast("bigint").alias("id"), col(vector).cast(f"array<{kind}>").alias("vector"))
    doubles = F.col("vector").cast("array<double>")
    rows = rows.withColumn("good", valid_vector(doubles) & F.col("id").isNotNull())
    good = rows.filter("good").select("id", "vector")
    reps = saved(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    sizes = {r[0]: r[1] for r in reps.groupBy(F.size("vector")).count().collect()}
    if sizes:
        counts, edges, temporary = _joined(reps, sizes, kind, least, cell_rows)
    else:
        empty = reps.select(F.col("rep").alias("u"), F.col("rep").alias("v"), F.col("copies").alias("links")).limit(0)
        counts, edges, temporary = empty, empty, []
    roots = components(edges.select("u", "v"), "vector-components")
    for table in temporary:
        discard(table)
    member = good.join(reps.select("vector", "rep", "copies"), "vector").select("id", "rep", "copies")
    links = counts.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    found = (
        member.join(links, "rep", "left")
        .join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    alone = rows.filter("NOT good").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return found.unionByName(alone).select(
        F.col("id").alias(key),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def _joined(reps: DataFrame, sizes: dict[int, int], kind: str, least: float, cell_rows: int):
    pivots = {}
    for size, count in sizes.items():
        wanted = min(MAX_PIVOTS, math.ceil(count / cell_rows))
        chosen = reps.filter(F.size("vector") == size).orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()
        pivots[size] = unit_rows(np.array([r["vector"] for r in chosen], dtype=float))
    reach = 2 * math.sqrt(2 - 2 * least) + 1e-9

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["vector"].map(len).to_numpy()
            for size in np.unique(lengths):
                part = batch[lengths == size].reset_index(drop=True)
                points, centres = unit_rows(np.stack(part["vector"].to_numpy()).astype(float)), pivots[int(size)]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (points @ centres.T)))
                home = apart.argmin(axis=1)
                # A pair across two cells is compared in the later one.
                near = apart - apart[np.arange(len(part)), home][:, None] <= reach
                near &= np.arange(len(centres)) > home[:, None]
                yield part.assign(size=size, cell=home, visits=[np.flatnonzero(x) for x in near])

    schema = f"vector array<{kind}>, rep bigint, copies bigint, size int, cell int, visits array<int>"
    placed = saved(reps.mapInPandas(place, schema), "cells")
    homes = placed.groupBy("size", "cell").agg(F.count("*").alias("home"))
    guests = placed.select("size", F.explode("visits").alias("cell")).groupBy("size", "cell").agg(F.count("*").alias("guest"))
    # One row per pivot.
    plan = homes.join(guests, ["size", "cell"], "left").select(
        "size", "cell",
        F.ceil(F.col("home") / cell_rows).cast("int").alias("parts"),
        F.ceil(F.coalesce("guest", F.lit(0)) / cell_rows).cast("int").alias("guest_parts"),
    )
    plan = F.broadcast(plan)
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    inside = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(F.least(own, q).alias("a"), F.greatest(own, q).alias("b"), F.lit(False).alias("guest")),
    )
    across = F.when(
        F.col("guest_parts") > 0,
        F.transform(F.sequence(F.lit(0), F.col("guest_parts") - 1), lambda q: F.struct(own.alias("a"), q.alias("b"), F.lit(True).alias("guest"))),
    ).otherwise(F.array().cast("array<struct<a:int,b:int,guest:boolean>>"))
    at_home = placed.join(plan, ["size", "cell"]).select(
        "size", "cell", "rep", "copies", "vector", own.alias("part"), F.lit(False).alias("visitor"), F.explode(F.concat(inside, across)).alias("task")
    )
    visiting = placed.select("size", F.explode("visits").alias("cell"), "rep", "copies", "vector").join(plan, ["size", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("guest_parts")).cast("int")
    )
    visiting = visiting.select(
        "size", "cell", "rep", "copies", "vector", "part", F.lit(True).alias("visitor"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(q.alias("a"), F.col("part").alias("b"), F.lit(True).alias("guest")))).alias("task"),
    )

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        _, _, a, b, guest = key
        if guest:
            left, right = group[~group["visitor"]], group[group["visitor"]]
        else:
            left, right = group[group["part"] == a], group[group["part"] == b]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        return _block(left, right, not guest and a == b, least)

    tasks = at_home.unionByName(visiting).select("*", "task.a", "task.b", "task.guest").drop("task")
    blocks = tasks.groupBy("size", "cell", "a", "b", "guest").applyInPandas(compare, "u bigint, v bigint, links bigint")
    blocks = saved(blocks, "links")
    return blocks, blocks, [placed]
