from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tabweave.operators import cards, chats
from tabweave.plans.corpus import build_corpus, conversation_count
from tabweave.plans.generating import columnwise_batch, generate_rows, generation_groups
from tabweave.plans.profiling import VARIANTS, profile_cards, profile_table
from tabweave.session import durable
from tabweave.sources import read_corpus, read_roles, target_column, write_corpus, write_scores

ROLES = {"Cloud Cover": "str", "wet": "str", "Rain (%)": "float", "hours": "int"}


@pytest.fixture(scope="module")
def weather(spark):
    rows = [
        (i, ["clear", "grey", "black"][i % 3], "yes" if i % 3 else "no", 10.0 * (i % 3) + i % 7 * 0.5, i % 24) for i in range(240)
    ]
    kinds = "id bigint, `Cloud Cover` string, wet string, `Rain (%)` double, hours bigint"
    return durable(spark.createDataFrame(rows, kinds))


@pytest.fixture(scope="module")
def profile(weather):
    return profile_table(weather, ROLES, "id")


def test_variants_differ_as_described(profile):
    sheets = {v: {r.column: r.card for r in profile_cards(profile, v).collect()} for v in VARIANTS}
    assert "with probabilities [" in sheets["basic"]["wet"] and "of 100 rows" in sheets["basic_bettercat"]["wet"]
    assert "Cramér's V" in sheets["basic"]["wet"] and "depends on" in sheets["json_relationships"]["wet"]
    assert "a strong link" in sheets["relationships"]["wet"] and "link" not in sheets["json_relationships"]["wet"]
    assert sheets["columnwise_relationships_json_nodist"]["hours"].splitlines()[2].startswith("Numbers with")
    assert sheets["columnwise_relationships_json"]["hours"].splitlines()[2].startswith("Evenly distributed")


def test_card_order_and_descriptions(profile):
    rows = profile_cards(profile, "basic", descriptions={"wet": "Did it rain?"}).orderBy("position").collect()
    assert [r.column for r in rows] == list(ROLES)
    assert rows[1].card.splitlines()[:3] == ["# Column: wet", "Type: str", "Did it rain?"]


def test_too_many_categories_raise_if_asked(spark):
    rows = [("c", f"v{i}", i, 0.25) for i in range(4)]
    labels = spark.createDataFrame(rows, "column string, value string, code int, prob double")
    with pytest.raises(Exception, match="too many categories"):
        cards.category_card(labels, max_values=3).collect()
    assert cards.category_card(labels).count() == 1


def test_unknown_statistic():
    with pytest.raises(ValueError, match="unknown statistics"):
        cards.selected_stats(["mode"])
    assert cards.selected_stats(["kurtiosis", "min"]) == ["min", "kurtosis"]


def test_groups_cover_all_columns_once_and_are_free_of_edges(spark, profile):
    groups = generation_groups(profile)
    assert sorted(c for g in groups for c in g) == sorted(ROLES)
    near = {(r.column, r.other) for r in profile.edges.collect()}
    assert near and not any((a, b) in near for g in groups for a in g for b in g)


def test_groups_hold_eight_columns_at_most(spark):
    columns = spark.createDataFrame([(f"c{i:02}", i) for i in range(19)], "column string, position int")
    edges = spark.createDataFrame([], "column string, other string")
    groups = [r.columns for r in chats.column_groups(columns, edges).orderBy("group_no").collect()]
    assert [len(g) for g in groups] == [8, 8, 3]


def test_opening_chats(spark, profile):
    sheet = profile_cards(profile, "basic")
    pair = chats.build_chats(sheet, list(ROLES), 3, "csv").collect()
    assert len(pair) == 3 and [m.role for m in pair[0].messages] == ["system", "user"]
    single = chats.build_chats(sheet, list(ROLES), 1, "json", system=False).first()
    assert [m.role for m in single.messages] == ["user"] and '"Rain (%)": "<value>"' in single.messages[0].content
    assert chats.build_chats(None, [], 2, "columnwise", spark, system=False).first().messages == []


def test_over_provisioning():
    assert chats.over_provisioned(100, 0) == 100 and chats.over_provisioned(100, 3) == int(100 / 0.96**3)
    assert [chats.over_provisioned(10, g, "older") for g in (1, 4, 20)] == [10, 20, 30]


def test_completion_retries(spark):
    talks = spark.createDataFrame([(i, [("user", f"hi {i}")]) for i in range(5)], f"chat_id bigint, messages {chats.MESSAGES}")

    class Flaky:
        def __init__(self):
            self.calls = 0

        def __call__(self, batch):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return [t[0]["content"].upper() for t in batch]

    rows = chats.complete_chats(talks.coalesce(1), Flaky()).collect()
    assert {r.response for r in rows} == {f"HI {i}" for i in range(5)} and all(r.error is None for r in rows)
    short = chats.complete_chats(talks.coalesce(1), lambda batch: ["one"]).collect()
    assert all(r.response is None and r.error.startswith("ValueError") for r in short)


def csv_model(lines):
    return lambda batch: ["\n".join(lines) for _ in batch]


def test_top_up_to_the_asked_count(spark, profile):
    model = csv_model(["grey,yes,10.5,3", "grey,yes,999,3", "unknown,yes,10.5,3"])
    rows = generate_rows(profile, model, 37, "basic").collect()
    assert len(rows) == 37 and max(r.batch for r in rows) >= 1
    assert {(r["Rain (%)"], r.hours) for r in rows} == {(10.5, 3)}


def test_no_valid_row_is_an_error(profile):
    with pytest.raises(RuntimeError, match="no valid row"):
        generate_rows(profile, csv_model(["nothing"]), 10, "basic")


VALUES = {"Cloud Cover": "grey", "wet": "yes", "Rain (%)": 10.5, "hours": 3}


def json_model(rows_for):
    def answer(batch):
        out = []
        for i, talk in enumerate(batch):
            cols = re.findall(r'"([^"]+)": "<value>"', talk[-1]["content"])
            out.append("\n".join(json.dumps({c: VALUES[c] for c in cols}) for _ in range(rows_for(i, talk))))
        return out

    return answer


def test_columnwise_rows(profile):
    rows = generate_rows(profile, json_model(lambda i, talk: 20), 30, "columnwise_relationships_json").collect()
    assert len(rows) == 30 and all(r["Rain (%)"] == 10.5 for r in rows)


def test_columnwise_drops_chats_that_stay_short(profile):
    """Every chat fails its first turn: three rounds without progress end the batch, and the failures are kept."""
    batch = columnwise_batch(profile, json_model(lambda i, talk: 3), 4)
    assert batch.rows.count() == 0 and batch.failed.count() >= 3 * 4


def test_columnwise_history_is_trimmed(profile):
    lengths = []

    def rows_for(i, talk):
        assert len(talk) in (2, 4)
        return 20

    batch = columnwise_batch(profile, json_model(rows_for), 2)
    assert batch.rows.count() > 0 and lengths == []


def test_corpus(spark, weather):
    corpus = durable(build_corpus(weather, ROLES, "wet", ["id"], conversations=15, seed=3))
    rows = corpus.collect()
    assert {r.conv_id for r in rows} == set(range(15))
    for r in rows:
        assert r.split == ("eval" if r.conv_id % 5 == 0 else "train")
        assert [m.role for m in r.messages] == (
            ["system", "user", "assistant"] if r.group_no == 0 else ["system", "user", "assistant", "user", "assistant"]
        )
    for conv in range(15):
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.group_no)
        assert [r.group_no for r in mine] == list(range(len(mine)))
        last = json.loads("[" + mine[-1].messages[-1].content.replace("}\n{", "},{") + "]")
        assert 20 <= len(last) <= 25 and "wet" in last[0] and 2 <= len(last[0]) <= 4
        known = [json.loads("[" + m.messages[-1].content.replace("}\n{", "},{") + "]")[0] for m in mine]
        for a, b in zip(known, known[1:]):
            assert list(b)[: len(a)] == list(a) and all(b[c] == a[c] for c in a)


def test_corpus_sizes():
    assert [conversation_count(n) for n in (50, 74, 75, 500, None)] == [250, 250, 500, 500, 750]


def test_json_rows_keep_nulls_quotes_and_large_numbers(spark):
    df = spark.createDataFrame([(1, 'a "b"\n', None, 12345678901.5)], "id int, `x y` string, n int, `d%` double")
    text = chats.rows_to_json(df, ["x y", "n", "d%"], ["id"], ["id"]).first().response
    assert json.loads(text) == {"x y": 'a "b"\n', "n": None, "d%": 12345678901.5} and "E" not in text


def test_files(spark, tmp_path):
    (tmp_path / "types.json").write_text('{"b b": "str",\n "a": "int"}')
    (tmp_path / "descriptions.json").write_text('{"b b": "Role: Target, Description: class", "a": "Role: Feature"}')
    roles = read_roles(spark, str(tmp_path / "types.json"), str(tmp_path / "descriptions.json"))
    assert [(r.column, r.role) for r in roles.orderBy("position").collect()] == [("b b", "str"), ("a", "int")]
    assert target_column(roles) == "b b"
    with pytest.raises(ValueError):
        target_column(read_roles(spark, str(tmp_path / "types.json")))
    scores = spark.createDataFrame([("m", 0, 0.5)], "model string, repetition int, score double")
    for _ in range(2):
        write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).count() == 2
    corpus = spark.createDataFrame(
        [(0, "eval", [("user", "x")]), (1, "train", [("user", "y")])], f"conv_id int, split string, messages {chats.MESSAGES}"
    )
    write_corpus(corpus, str(tmp_path / "corpus"))
    assert read_corpus(spark, str(tmp_path / "corpus"), "eval").first().messages[0].content == "x"
    assert read_corpus(spark, str(tmp_path / "corpus")).count() == 2


def test_chat_text_splits_only_if_asked(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    whole = chats.chat_to_text(turns).collect()
    assert len(whole) == 1 and whole[0].part == 0
    parts = chats.chat_to_text(turns, turns_per_text=1200).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2] and "\n".join(p.text for p in parts) == whole[0].text


def test_cards_of_very_many_labels(spark):
    """A million labels: cards name the heaviest and count the others."""
    from tabweave.operators import cards

    ids = spark.range(1_000_000)
    labels = ids.select(F.lit("c").alias("column"), F.concat(F.lit("v"), F.col("id")).alias("value"), F.col("id").alias("code"), (1 / (F.col("id") + 1)).alias("prob"))
    card = cards.category_card(labels, "no_stats", top=3).first().body
    assert card == "Categories:\n- v0\n- v1\n- v2\nand 999997 rarer values"
    shift = F.when(F.col("id") % 2 == 0, 1).otherwise(-1) / (F.col("id") + 1)
    by_label = ids.select(F.lit("x").alias("column"), F.lit("c").alias("other"), F.concat(F.lit("v"), F.col("id")).alias("label"), shift.alias("mean_shift"))
    by_cat = ids.select(F.lit("c").alias("column"), F.lit("d").alias("other"), (F.col("id") % 1000).cast("string").alias("condition"), F.concat(F.lit("v"), F.col("id")).alias("value"), shift.alias("shift"))
    edges = spark.createDataFrame([("x", "c", "eta", 0.6), ("c", "d", "cramers_v", 0.4)], "column string, other string, kind string, value double")
    got = {r.column: r.body for r in cards.relationship_card(edges, by_cat, by_label, {"c": "str", "d": "str", "x": "float"}, top=2).collect()}
    assert got["x"] == "x depends on c: higher for v0, v2 and 499998 more; lower for v1, v3 and 499998 more."
    assert got["c"] == "c depends on d: when d is 0, more often v0, v1000 and 998 more; when d is 1, more often ; and 998 more cases."


def test_profile_cards_name_all_of_few_labels(spark):
    from tabweave.plans.profiling import profile_cards, profile_table

    rows = spark.range(400).select("id", (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 7 * 2.0 + F.col("id") % 3).alias("x"))
    p = profile_table(rows, {"a": "str", "x": "float"}, "id", shapes=False)
    cards = [{r.column: r.card for r in profile_cards(p, "relationships", max_labels=m).collect()} for m in (None, 1000, 2)]
    assert cards[0] == cards[1] != cards[2] and "and 5 rarer values" in cards[2]["a"]


def test_evaluation_run(spark, tmp_path):
    """Incomplete rows and repetitions, saved results, and errors of one metric beside scores of others."""
    from tabweave.plans.evaluation import evaluate

    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 5).cast("string").alias("k"), (F.col("id") % 50).cast("double").alias("y"), F.lit(1).alias("junk"))

    def generate(profile, count):
        assert profile.edges is not None and count == 3 * 300
        return spark.range(count).select("id", (F.col("id") % 5).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 50).cast("double").alias("y"))

    def fails(train, test, synthetic):
        raise ValueError("no such score")

    metrics = [("rows-Count", lambda train, test, synth: synth.agg(F.count("*").cast("double").alias("score"))), ("bad-Count", fails)]
    run = evaluate(rows, {"k": "str", "y": "float"}, "y", "regression", ["id"], generate, rows=300, test_rows=100, dropped=["junk"], metrics=metrics, folder=str(tmp_path))
    assert (run.train.count(), run.test.count(), run.generated.count()) == (300, 100, 900) and run.train.columns == ["k", "target"]
    nulls = {(r.repetition, r.column): r.nulls for r in run.nulls.collect()}
    assert sum(nulls[i, "y"] for i in range(3)) == 100 and sum(nulls[i, "k"] for i in range(3)) == 0
    scores = {(r.model, r.repetition, r.metric): (r.score, r.error) for r in run.scores.collect()}
    assert all(scores["synthetic", i, "rows-Count"] == (300.0 - nulls[i, "y"], None) for i in range(3)) and scores["GT", 0, "rows-Count"] == (300.0, None)
    assert scores["synthetic", 1, "bad-Count"] == (-1.0, "no such score")
    assert spark.read.json(f"{tmp_path}/scores").count() == 8
    assert spark.read.option("header", True).csv(f"{tmp_path}/generated").groupBy("repetition").count().count() == 3


def test_long_replies_are_not_sent_through_the_driver(spark):
    """A plan takes the replies of many chats for a small table; they must not be broadcast for that."""
    talks = spark.range(60).select(F.col("id").alias("chat_id"), F.array(chats.message("user", F.lit("?"))).alias("messages"))
    replies = spark.range(60).select(F.col("id").alias("chat_id"), F.repeat(F.lit("x"), 10_000).alias("response"))
    valid = spark.range(90).select((F.col("id") % 45).alias("chat_id"))
    out = chats.route_chats(talks, replies, valid, replies, min_rows=2)
    assert out.groupBy("status").count().orderBy("status").collect() == [("accepted", 45), ("retry", 15)]
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
