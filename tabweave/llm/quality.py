"""Quality: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Labellers look at one trait each and vote good, bad or, where it cannot be told or lies in between, not at all. No labels are read: the counts of all vote patterns in
the corpus tell how far the labellers can be trusted, and each pattern gets the probability that its documents are good.
These probabilities train a logistic regression on hashed word shapes, which scores every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.chunks import word_chunks
from tabweave.llm.common import col, list_array, map_text, saved

# Documents that train the scorer, at most about so many; votes are counted over all.
FIT_ROWS = 20_000
BUCKETS = 256
LABELLERS = ("symbols", "capitals", "repeats", "separators", "sentences", "function_words", "variety", "shouts", "plain_words", "stutter")

# Function words of four languages.
FUNCTION_WORDS = frozenset("the of and to in a is that it for de la le les des et en un une que el los las y del der die das und den von zu ein eine".split())

# A word with common marks around it, not in capitals.
PLAIN = re.compile(r"[\"'(«„“¿¡]*[^\W\d_]?[^\W\d_A-ZÀ-Þ]*(?:['’-][^\W\d_]+)*[.,;:!?\"')»“”…]{0,2}|[\d.,:%-]+")
COMMON_MARKS = ".,;:!?\"'()«»„“”¿¡…"
SHAPE_RUN = re.compile(r"(.)\1+")


def shape(chunk: str) -> str:
    """A whole chunk with letters as x or X, digits as 9, and runs as one character."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in chunk)
    return SHAPE_RUN.sub(r"\1", kinds)


class ChunkTraits:
    """Traits of the chunks of a worker's latest texts: eight flags and the bucket of the shape."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def traits(self, chunk: str) -> tuple:
        letters = sum(map(str.isalpha, chunk))
        marks = len(chunk) - sum(map(str.isalnum, chunk))
        core = chunk.strip(COMMON_MARKS).lower()
        return (
            1 if letters and marks >= 3 and not chunk.isalnum() else 0,
            1 if letters > 1 and chunk.upper() == chunk and chunk.lower() != chunk else 0,
            1 if not letters and marks else 0,
            1 if chunk[-1:] in (".", "!", "?", "…") else 0,
            1 if core in FUNCTION_WORDS else 0,
            1 if chunk.endswith("!!") else 0,
            1 if letters else 0,
            1 if PLAIN.fullmatch(chunk) else 0,
            xxhash.xxh32_intdigest(shape(chunk).encode("utf-8", "surrogatepass")) % BUCKETS,
        )

    def rows(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        out = []
        for chunk in chunks:
            row = self.known.get(chunk)
            if row is None:
                row = self.traits(chunk)
                if len(chunk) <= 64:
                    self.known[chunk] = row
            out.append(row)
        return np.array(out, dtype=np.int64).reshape(-1, 9)

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Votes (1 good, 0 bad, 2 none) of each labeller and the hashed shape rates of each text."""
        count = len(texts)
        if not count:
            return np.zeros((0, len(LABELLERS)), np.int8), np.zeros((0, BUCKETS), np.float32)
        codes, offsets, chunks = word_chunks(texts)
        table = self.rows(chunks)
        owner = np.repeat(np.arange(count), np.diff(offsets))
        sums = np.stack([np.bincount(owner, weights=table[:, i][codes], minlength=count) for i in range(8)], axis=1)
        total = np.diff(offsets).astype(float)
        hashed = np.bincount(owner * BUCKETS + table[:, 8][codes], minlength=count * BUCKETS).reshape(count, BUCKETS)
        size = np.maximum(total, 1)
        rates = sums / size[:, None]
        # Distinct words of each text.
        pairs = np.unique(owner.astype(np.int64) * (len(chunks) + 1) + codes)
        variety = np.bincount(pairs // (len(chunks) + 1), minlength=count) / size
        repeats, lines = _repeats(texts)
        votes = np.full((count, len(LABELLERS)), 2, dtype=np.int8)

        def vote(i: int, good: np.ndarray, bad: np.ndarray, where: np.ndarray) -> None:
            votes[where & good, i] = 1
            votes[where & bad, i] = 0

        same = np.zeros(len(codes))
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        stutter = np.bincount(owner, weights=same, minlength=count) / size
        some, many = total >= 5, total >= 40
        vote(0, rates[:, 0] < 0.05, rates[:, 0] > 0.3, some)
        vote(1, rates[:, 1] < 0.1, rates[:, 1] > 0.4, some)
        vote(2, repeats < 0.1, repeats > 0.35, lines >= 3)
        vote(3, rates[:, 2] < 0.03, rates[:, 2] > 0.15, some)
        vote(4, (rates[:, 3] > 0.02) & (rates[:, 3] < 0.5), (rates[:, 3] < 0.005) | (rates[:, 3] > 0.6), many)
        vote(5, rates[:, 4] > 0.1, rates[:, 4] < 0.03, total >= 15)
        vote(6, variety > 0.25, variety < 0.12, (total >= 100) & (total < 2_000))
        vote(7, rates[:, 5] < 0.02, rates[:, 5] > 0.15, some)
        vote(8, rates[:, 7] > 0.9, rates[:, 7] < 0.6, some)
        vote(9, stutter < 0.05, stutter > 0.2, some)
        features = np.concatenate((np.sqrt(hashed / size[:, None]), np.stack((repeats, np.minimum(1, rates[:, 4]), np.sqrt(stutter)), axis=1)), axis=1)
        return votes, features.astype(np.float32)


def _repeats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Share of each text's lines that stand earlier in it, and its number of lines."""
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    span = int(codes.max()) + 1 if len(codes) else 1
    distinct = np.bincount(np.unique(owner * span + codes) // span, minlength=len(texts))
    return 1 - distinct / np.maximum(counts, 1), counts


def judged(df: DataFrame, text: str = "text", carry: bool = True) -> DataFrame:
    """``(_row, _votes, _hashed)``: the row, with or without its text, the votes on the whole text as digits and its
    hashed features."""

    def run():
        table = ChunkTraits()

        def compute(texts: pa.Array) -> list[pa.Array]:
            votes, features = table.judge(texts)
            return [pa.array(["".join(map(str, v)) for v in votes.tolist()], pa.string()), list_array(features)]

        return compute

    return map_text(df, text, carry, run, [T.StructField("_votes", T.StringType()), T.StructField("_hashed", T.ArrayType(T.FloatType()))])


def fit_labellers(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good per vote pattern, each labeller's vote probabilities ``[class, labeller, vote]``, and the prior.

    Expectation-maximisation over pattern counts, started from the majority vote. Ties start at one half.
    """
    keys = sorted(patterns)
    votes = np.array([[int(c) for c in k] for k in keys])
    counts = np.array([patterns[k] for k in keys], dtype=float)
    good, bad = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    # A bad trait is rarer than its absence, so one bad vote outweighs several good ones at the start.
    posterior = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    # A labeller that does not vote says nothing.
    one_hot = np.stack([votes == v for v in range(2)], axis=2).astype(float)
    for _ in range(rounds):
        mass = np.stack(((1 - posterior) * counts, posterior * counts))
        prior = np.clip(mass[1].sum() / counts.sum(), 0.01, 0.99)
        table = np.einsum("cn,nlv->clv", mass, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("nlv,clv->cn", one_hot, np.log(table)) + np.log([1 - prior, prior])[:, None]
        following = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(following - posterior).max() < 1e-9
        posterior = following
        if done:
            break
    return dict(zip(keys, posterior.tolist())), table, float(prior)


@dataclass
class QualityModel:
    posteriors: dict[str, float]
    accuracies: np.ndarray
    prior: float
    scorer: LogisticRegressionModel | None

    def score(self, rows: DataFrame) -> DataFrame:
        """``judged`` rows with ``_score``, the probability of good."""
        if self.scorer is None:
            return rows.withColumn("_score", F.lit(float(self.prior)))
        vector = rows.withColumn("_vector", array_to_vector(F.col("_hashed").cast("array<double>")))
        return self.scorer.transform(vector).withColumn("_score", vector_to_array("_chance")[1])


def fit_quality(rows: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from ``judged`` rows: accuracies from the vote counts of all, the scorer from about ``fit_rows`` of them.

    Patterns are at most three to the power of the number of labellers. Training rows are drawn by a hash of votes and features, so
    copies are drawn together and a repeated task draws the same rows.
    """
    patterns = {r["_votes"]: r["count"] for r in rows.groupBy("_votes").count().collect()}
    if not patterns:
        return QualityModel({}, np.zeros((2, len(LABELLERS), 2)), 0.5, None)
    posteriors, accuracies, prior = fit_labellers(patterns)
    certain = {p > 0.5 for p in posteriors.values()}
    if len(certain) < 2:
        return QualityModel(posteriors, accuracies, float(np.average(list(posteriors.values()), weights=[patterns[k] for k in posteriors])), None)
    share = min(1.0, fit_rows / sum(patterns.values()))
    drawn = rows.select("_votes", "_hashed").filter(F.pmod(F.xxhash64("_votes", "_hashed"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    chances = rows.sparkSession.createDataFrame(list(posteriors.items()), "_votes string, _good double")
    drawn = saved(drawn.join(F.broadcast(chances), "_votes").select("_hashed", "_good").coalesce(4), "quality-examples")
    # Each document stands once for each class, weighted by its probability.
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("_good").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("_good")).alias("w"))))
    examples = drawn.select(array_to_vector(F.col("_hashed").cast("array<double>")).alias("_vector"), sides.alias("s")).select("_vector", "s.y", "s.w").filter("w > 0.001")
    scorer = LogisticRegression(
        featuresCol="_vector", labelCol="y", weightCol="w", predictionCol="_class", rawPredictionCol="_raw", probabilityCol="_chance", regParam=1e-4, maxIter=60
    ).fit(examples)
    return QualityModel(posteriors, accuracies, prior, scorer)


def score_quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, votes, weak_label, score, kept)`` for every row: the votes, the probability they give, and the score of the
    trained scorer, by which documents of one half and more are kept.

    Null and empty texts get no votes but on what an empty text has; extra columns are left out; repeated rows score alike.
    """
    rows = saved(judged(df.select(col(key).alias(key), col(text).alias(text)), text, False), "judged")
    model = fit_quality(rows)
    chances = df.sparkSession.createDataFrame(list(model.posteriors.items()), "_votes string, weak_label double")
    scored = model.score(rows).join(F.broadcast(chances), "_votes", "left")
    return scored.select(f"_row.`{key}`", F.col("_votes").alias("votes"), "weak_label", F.col("_score").alias("score")).withColumn("kept", F.col("score") >= 0.5)


def drop_poor(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose whole text scores one half or more, all columns kept. Texts are read once more for that; nothing is
    shuffled."""
    model = fit_quality(saved(judged(df.select(col(text).alias(text)), text, False), "judged"))
    return model.score(judged(df, text)).filter("_score >= 0.5").select("_row.*")
