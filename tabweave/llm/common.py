"""Helpers of the text operators: durable tables, word hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.session import checkpoint_folder

SHINGLE_WORDS = 5
# Entries a per-worker memo may hold before it starts afresh.
MEMO_ENTRIES = 300_000
# Bytes of text handled together, at least one document.
BATCH_BYTES = 4_000_000
# The same where tables over the words of a batch are built, several times as large as the texts.
WORD_BATCH_BYTES = 1_000_000

# What is no letter, mark or digit at either end of a chunk.
EDGES = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark)}/tabweave/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder behind a ``saved`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, text: str, carry: bool) -> DataFrame:
    """The columns of ``df`` as one struct ``_row``, so that no name of theirs can clash, and the text.

    With ``carry`` the text stays in the struct only; without, it is left out there and stands beside it as ``_text``.
    """
    names = [c for c in df.columns if carry or c != text]
    row = F.struct(*[col(c).alias(c) for c in names]) if names else F.struct(F.lit(True).alias("_"))
    return df.select(row.alias("_row"), *([] if carry else [col(text).alias("_text")]))


def boxed_text(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts of a batch of ``boxed`` rows."""
    if "_text" in batch.schema.names:
        return batch.column(batch.schema.get_field_index("_text"))
    row = batch.column(batch.schema.get_field_index("_row"))
    return row.field(row.type.get_field_index(text))


def map_text(df: DataFrame, text: str, carry: bool, run: Callable, added: list[T.StructField]) -> DataFrame:
    """``boxed`` rows with columns computed from their texts, about ``WORD_BATCH_BYTES`` of text at once.

    ``run()`` is called once per task and returns a function from an array of texts to the arrays of ``added``.
    """
    rows = boxed(df, text, carry)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = run()
        for batch in batches:
            texts = boxed_text(batch, text)
            row = batch.column(batch.schema.get_field_index("_row"))
            for i, j in slices(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), WORD_BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), *compute(texts.slice(i, j - i))], ["_row", *[f.name for f in added]])

    return rows.mapInArrow(task, T.StructType([rows.schema["_row"], *added]))


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the public splitmix64 finaliser); works on unsigned 64-bit arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo from a chunk between white space to the 64-bit hash of its word.

    The word is the chunk in lower case without what is no letter, mark or digit at its ends; a chunk of nothing else is its
    own word.
    """

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        lower = chunk.lower()
        word = lower if lower.isalnum() else EDGES.sub("", lower) or lower
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        # A very long chunk is not worth keeping.
        if len(chunk) <= 64:
            self[chunk] = value
        return value


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    chunks = (text or "").split()
    return np.fromiter(map(memo.__getitem__, chunks), dtype=np.uint64, count=len(chunks))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``size`` words; one of all words if there are fewer, none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def slices(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``budget``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges (u, v)``; a component is its smallest node.

    Alternating stars: every larger neighbour, then every smaller one, is linked to the smallest neighbour, until each
    node points at its root. Edges never outnumber the input, and the number of rounds grows with the logarithm of the
    path lengths. Only a count and a checksum per round reach the driver. Nodes without edges, loops and nulls do not
    appear.
    """
    current = saved(_oriented(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")), name)
    mark = _mark(current)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        turned = _small_star(_large_star(current))
        following = saved(turned, name)
        seen = _mark(following)
        discard(current)
        current = following
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point from the larger node to the smaller one already.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))
