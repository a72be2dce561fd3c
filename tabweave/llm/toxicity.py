"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features are rates per word: hits of a lexicon (common insults, and learned words and word starts, in bands of evidence), hits close to
a word of the second person, capitals, punctuation, and signs of obfuscation (marks or digits inside words, stretched
letters, single letters in a row). The learned entries come from labelled documents as well: words and word starts that
toxic documents use far more often than others. They are learned on some folds, the trees on another and the calibration on
a third, so that none judges its own examples.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.chunks import word_chunks
from tabweave.llm.common import boxed, col, list_array, map_text, saved

# Labelled rows used for fitting, at most about so many; the rest of the labels is not needed.
FIT_ROWS = 20_000
MAX_LEXICON = 5_000
START_LETTERS = (4, 5, 6)
# A lexicon entry occurs in this share of the toxic fitting documents, in LEAST_DOCS of them, and this much more often.
LEAST_SHARE = 0.004
LEAST_DOCS = 3
LEAST_RATIO = 12.0
NEAR_WORDS = 5

# Words of the second person in four languages.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vuestro".split())
# Common insults in four languages, known before any label is read.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb fool imbecile loser losers pathetic worthless disgusting scum scumbag trash garbage filth filthy"
    " vermin clown jerk creep freak liar coward bastard bitch asshole retard retarded ugly"
    " dumm trottel abschaum ekelhaft wertlos versager arschloch dreck müll depp idioten hurensohn"
    " imbécile crétin connard salaud ordure débile pathétique dégoûtant minable abruti"
    " idiota imbécil estúpido estúpida basura escoria patético patética asqueroso inútil cabrón payaso".split()
)
# Digits and marks written for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

INNER = re.compile(r"[^\W_][^\w\s'’-]+[^\W_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NOT_LETTERS = re.compile(r"[\W\d_]+")

# Of each distinct chunk: what the rates are made of.
CHUNK_FEATURES = ("words", "strong", "weak", "hidden", "you", "capitals", "marks", "shouts", "digits", "inner", "stretched", "single", "letters")
FEATURES = len(CHUNK_FEATURES) + 4


def words_of(chunk: str) -> tuple[str, str]:
    """The letters of a chunk in lower case, as they are and with look-alikes read as letters."""
    low = unicodedata.normalize("NFKC", chunk).lower()
    return NOT_LETTERS.sub("", low), NOT_LETTERS.sub("", low.strip(".,;:!?\"'()").translate(LOOKALIKES))


def entries_of(word: str) -> list[str]:
    """Lexicon entries a word can match: itself, and its starts with a hyphen behind."""
    return [word, *(f"{word[:n]}-" for n in START_LETTERS if len(word) >= n)] if len(word) > 2 else []


class ChunkTable:
    """Features of the chunks of a worker's latest texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple] = {}

    def features(self, chunk: str) -> tuple:
        plain, read = words_of(chunk)
        lexicon = self.lexicon
        score = max((lexicon.get(e, 0.0) for e in entries_of(plain)), default=0.0)
        hidden = 0.0 if score or read == plain else max((lexicon.get(e, 0.0) for e in entries_of(read)), default=0.0)
        score = max(score, hidden)
        letters = sum(map(str.isalpha, chunk))
        return (
            1.0 if plain else 0.0, 1.0 if score >= 2 else 0.0, 1.0 if 0 < score < 2 else 0.0, 1.0 if hidden else 0.0,
            1.0 if plain in SECOND_PERSON else 0.0, 1.0 if letters > 1 and chunk.upper() == chunk else 0.0,
            float(len(chunk) - sum(map(str.isalnum, chunk))), float(chunk.count("!") + chunk.count("?")),
            float(sum(map(str.isdigit, chunk))), 1.0 if INNER.search(chunk) else 0.0, 1.0 if STRETCHED.search(plain) else 0.0,
            1.0 if len(plain) == 1 else 0.0, float(letters),
        )

    def rows(self, chunks: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        for chunk in chunks:
            row = known.get(chunk)
            if row is None:
                row = self.features(chunk)
                if len(chunk) <= 64:
                    known[chunk] = row
            out.append(row)
        return np.array(out, dtype=np.float64).reshape(-1, len(CHUNK_FEATURES))

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """One row of features per text; texts without words have rates of zero."""
        if not len(texts):
            return np.zeros((0, FEATURES))
        codes, offsets, chunks = word_chunks(texts)
        table = self.rows(chunks)
        # A text's sums are differences of running sums, so that texts without chunks need no care.
        hits = (table[:, 1] + table[:, 2] > 0)[codes]
        you = table[:, 4][codes] > 0
        near = np.zeros(len(codes), dtype=bool)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for gap in range(1, NEAR_WORDS + 1):
            same = owner[gap:] == owner[:-gap]
            near[gap:] |= hits[gap:] & you[:-gap] & same
            near[:-gap] |= hits[:-gap] & you[gap:] & same
        sums = np.empty((len(texts), len(CHUNK_FEATURES)))
        for i in range(len(CHUNK_FEATURES)):
            sums[:, i] = np.bincount(owner, weights=table[:, i][codes], minlength=len(texts))
        close = np.bincount(owner, weights=near, minlength=len(texts))
        distinct = np.zeros(len(texts))
        if hits.any():
            pairs = np.unique(np.stack((owner[hits], codes[hits])), axis=1)
            distinct = np.bincount(pairs[0], minlength=len(texts)).astype(float)
        words = np.maximum(sums[:, :1], 1)
        rates = sums / words
        rates[:, 0] = np.log1p(sums[:, 0])
        extra = np.stack((sums[:, 1], sums[:, 1] + sums[:, 2], close / words[:, 0], distinct), axis=1)
        return np.concatenate((rates, np.log1p(extra)), axis=1)


def text_features(df: DataFrame, lexicon: dict[str, float], text: str = "text", carry: bool = True) -> DataFrame:
    """``(_row, _features)``: the row, with or without its text, and the features of the whole text."""

    def run():
        table = ChunkTable(lexicon)
        return lambda texts: [list_array(table.matrix(texts))]

    return map_text(df, text, carry, run, [T.StructField("_features", T.ArrayType(T.DoubleType()))])


def fold_of(key: str) -> Column:
    """crc32 of the key as text, modulo five; fold 0 is held out from all learning."""
    return F.pmod(F.crc32(col(key).cast("string")), F.lit(5)).cast("int")


@dataclass
class ToxicityModel:
    """``trees`` and ``curve`` are None if the labels hold one class only; every score is then ``rate``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float

    def score(self, df: DataFrame, text: str = "text", carry: bool = True) -> DataFrame:
        """``(_row, _score)``: the row, with or without its text, and the score from 0 to 1 of the whole text, null and
        empty texts included."""
        if self.trees is None:
            return boxed(df, text, carry).select("_row", F.lit(float(self.rate)).alias("_score"))
        rows = text_features(df, self.lexicon, text, carry).withColumn("_vector", array_to_vector("_features"))
        scored = self.curve.transform(_margins(self.trees.transform(rows)))
        return scored.select("_row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score"))).alias("_score"))


def _margins(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_margin", vector_to_array("probability")[1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS
) -> ToxicityModel:
    """Learn from the labelled documents outside fold 0.

    At most about ``fit_rows`` labelled rows are used, those with the smallest hashes of their key; only their keys are
    broadcast. Rows without a key or label are left out; a key with several labels is toxic if one of them says so.
    Folds 1 and 2 give the lexicon, 3 the trees, 4 the calibration; if a fold lacks a class, all of them are used.
    """
    known = labels.select(col(key).alias("id"), col(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("fold", fold_of("id")).filter("fold <> 0")
    count = known.count()
    share = min(1.0, fit_rows / max(count, 1))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = docs.select(col(key).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = saved(rows, "labelled")
    sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    total = sum(sizes.values())
    rate = sum(n for (_, y), n in sizes.items() if y) / total if total else 0.0
    if not 0 < rate < 1:
        return ToxicityModel({}, None, None, rate)
    full = all(sizes.get((f, y), 0) for f in (1, 2, 3, 4) for y in (0, 1))
    part = (lambda *folds: rows.filter(F.col("fold").isin(*folds))) if full else lambda *folds: rows
    lexicon = {word: 2.0 for word in INSULTS} | _lexicon(part(1, 2))
    example = text_features(rows, lexicon).select("_row.fold", F.col("_row.label").cast("double").alias("label"), "_features")
    example = saved(example.coalesce(4), "examples").withColumn("_vector", array_to_vector("_features"))
    pick = (lambda *folds: example.filter(F.col("fold").isin(*folds))) if full else lambda *folds: example
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_tree", maxIter=12, maxDepth=3, maxBins=64, stepSize=0.3, seed=7
    ).fit(pick(3))
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(_margins(trees.transform(pick(4))))
    return ToxicityModel(lexicon, trees, curve, rate)


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """The strongest entries and their evidence: the logarithm of how much more often toxic documents have them, base 10."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple[str, int]] = []
            for value, label in zip(batch["text"], batch["label"]):
                held += [(e, int(label)) for e in {e for chunk in set((value or "").split()) for w in set(words_of(chunk)) for e in entries_of(w)}]
                if len(held) > 100_000:
                    yield pd.DataFrame(held, columns=["entry", "label"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["entry", "label"])

    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counts = rows.select("text", "label").mapInPandas(distinct, "entry string, label int")
    counts = counts.groupBy("entry").agg(F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_clean"))
    ratio = (F.col("in_toxic") / max(toxic, 1)) / ((F.col("in_clean") + 0.5) / max(clean, 1))
    kept = counts.filter(F.col("in_toxic") >= max(LEAST_DOCS, LEAST_SHARE * toxic)).withColumn("ratio", ratio)
    best = kept.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("in_toxic"), "entry").limit(MAX_LEXICON).collect()
    # Evidence of 2 and more is strong: no other document has the word, and enough toxic ones do.
    return {r["entry"]: 2.0 if r["in_clean"] == 0 else float(np.log10(r["ratio"]) / 2) for r in best}


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row of ``docs``, from a model learned on its labelled rows."""
    scored = fit_toxicity(docs, labels, key, text).score(docs.select(col(key).alias(key), col(text).alias(text)), text, False)
    return scored.select(f"_row.`{key}`", F.col("_score").alias("score")).select(
        key, F.coalesce(fold_of(key) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below one half, all columns kept."""
    return fit_toxicity(docs, labels, key, text).score(docs, text).filter("_score < 0.5").select("_row.*")
