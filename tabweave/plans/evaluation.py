"""A whole evaluation run: from a raw table to scores of generated rows beside real ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.seeded import seeded_hash
from tabweave.operators import fidelity, prepare
from tabweave.operators.dictionary import dictionary_sizes, encode
from tabweave.plans.profiling import TableProfile, dealt_once, profile_table
from tabweave.plans.scoring import Metric, default_metrics, score_table, with_control
from tabweave.roles import Roles
from tabweave.session import durable
from tabweave.sources.tables import write_generated, write_scores

# Rows of a repetition, repetitions and test rows of a run.
ROWS, REPETITIONS, TEST_ROWS = 1500, 3, 500
TARGET = "target"

# Makes at least so many rows in the roles of a profile, categories as codes, with further columns that together tell rows apart.
Generator = Callable[[TableProfile, int], DataFrame]


@dataclass(frozen=True)
class Evaluation:
    """What a run leaves behind; ``generated`` has a column ``repetition`` and the target under its own name."""

    profile: TableProfile
    train: DataFrame
    test: DataFrame
    generated: DataFrame
    nulls: DataFrame
    scores: DataFrame


def evaluate(
    df: DataFrame,
    roles: Roles,
    target: str,
    task: str,
    key: Sequence[str],
    generate: Generator,
    name: str = "synthetic",
    rows: int = ROWS,
    repetitions: int = REPETITIONS,
    test_rows: int = TEST_ROWS,
    dropped: Sequence[str] = (),
    metrics: Sequence[tuple[str | tuple[str, ...], Metric]] | None = None,
    folder: str | None = None,
    seed: int = 42,
    fast: bool = False,
) -> Evaluation:
    """Drop columns and incomplete rows, profile, encode, split, generate all repetitions at once, slice, score and save.

    ``key`` is unique and orders first appearances; its first column is a number. The split takes ``rows`` and ``test_rows`` in
    seeded hash order, at most three quarters and one quarter of the table. Generated rows are shuffled by a seeded hash,
    cut into repetitions, and lose their incomplete rows, whose nulls are counted first. ``metrics`` are by default those of the
    ``task``; they see the target as ``target``. With a ``folder`` generated rows and scores are written below it.
    """
    names = [*key, *[c for c in roles if c not in key]]
    kept = prepare.drop_incomplete(prepare.drop_columns(df, [c for c in dropped if c in df.columns]).select(*[F.col(f"`{c}`") for c in names]))
    # The profile and the split read a large table many times.
    kept = dealt_once(kept, key[0], names)
    profile = profile_table(kept, roles, key[0], fast=fast, dealt=True)
    coded = encode(kept, profile.dictionary, roles, dictionary_sizes(profile.dictionary))
    split = durable(prepare.train_test_split(coded, rows, test_rows, key=key, seed=seed, dealt=True))
    cols = [TARGET if c == target else c for c in roles]
    part = lambda which: prepare.rename_target(split.filter(F.col("split") == which).select(*[F.col(f"`{c}`") for c in roles]), target)
    train, test = part("train"), part("test")
    size = split.filter("split = 'train'").count()
    made = generate(profile, size * repetitions)
    order = [c for c in made.columns if c not in roles]
    placed = made.withColumn("_place", seeded_hash(seed, *[F.col(f"`{c}`") for c in order]))
    slices = durable(prepare.repetition_slices(placed, size, repetitions, ["_place", *order]).select(*[F.col(f"`{c}`") for c in roles], "repetition"))
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in roles]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in roles])
    nulls = slices.groupBy("repetition").agg(*counts).select("repetition", F.inline(pairs))
    synthetic = prepare.rename_target(prepare.drop_incomplete(slices), target)
    if metrics is None:
        metrics = default_metrics(cols, task, TARGET, durable(fidelity.fit_scaler(train, cols)) if task == "regression" else None)
    scores = score_table(with_control(synthetic, train, name), train, test, metrics)
    if folder is not None:
        write_generated(slices, f"{folder}/generated")
        write_scores(scores, f"{folder}/scores")
    return Evaluation(profile, train, test, slices, nulls, scores)
