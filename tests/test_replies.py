from __future__ import annotations

import pytest

from tabweave.operators import replies
from tabweave.plans.profiling import profile_table

ROLES = {"kind": "str", "size": "int", "price": "float"}


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(
        [(1, "red", 1, 0.5), (2, "it's", 100, 99.5), (3, "red", 50, 10.0)], "id bigint, kind string, size bigint, price double"
    )
    return profile_table(df, ROLES, "id", shapes=False)


def reasons(spark, p, parsed):
    checked = replies.validate_rows(parsed, p.numeric, p.dictionary, ROLES)
    return [r.reason for r in checked.orderBy("chat_id", "position").collect()]


def reply(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chat_id bigint, response string")


def test_csv_lines(spark):
    got = replies.parse_csv_replies(reply(spark, "kind,size,price\nred, 5 ,'7'\n\"red\",5,7,,\nred,5\na,b,c,d"), list(ROLES))
    assert [(r.kind, r["size"], r.price) for r in got.orderBy("position").collect()] == [
        ("kind", "size", "price"), ("red", "5", "7"), ("red", "5", "7"),
    ]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("red,5,7.5", None),
        ("red,5.9,7.5", None),
        ("red,100.9,7.5", None),
        ("red,101,7.5", "size: out of range"),
        ("blue,5,7.5", "kind: unknown category"),
        ("red,nan,7.5", "size: not a number"),
        ("red,inf,7.5", "size: not a number"),
        ("red,5,NaN", "price: not a number"),
        ("red,5,-Infinity", "price: not a number"),
        ("red,5,1e1", None),
        ("red,1e30,7.5", "size: not a number"),
        ("red,5f,7.5", "size: not a number"),
        ("red,,7.5", "size: not a number"),
        ("red,5,0.4", "price: out of range"),
    ],
)
def test_reasons(spark, tables, line, reason):
    assert reasons(spark, tables, replies.parse_csv_replies(reply(spark, line), list(ROLES))) == [reason]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('{"kind": "red", "size": 5, "price": 0.05}', [("red", "5", "0.05")]),
        ("{'kind': 'red', 'size': 5, 'price': 7.5}", [("red", "5", "7.5")]),
        ('{"kind": "red" "size": 5 "price": 7.5}', [("red", "5", "7.5")]),
        ('{"kind": "red",\n "size": 005,\n "price": 7.5,\n}', [("red", "5", "7.5")]),
        ('text {"kind": "red", "size": "5", "price": 7.5} and {"size": 5}', [("red", "5", "7.5")]),
        ('{"kind": "red", "size": 5, "price": [1, 2]}', []),
        ('{"kind": "red", "size": 5, "price": null}', []),
        ('{"a": {"kind": "red", "size": 5, "price": 7.5}}', [("red", "5", "7.5")]),
        ('{"kind": "red", "size": 5, "price": 7.5, "more": 1}', [("red", "5", "7.5")]),
        ("no object", []),
        ("{", []),
    ],
)
def test_json_objects(spark, text, rows):
    got = replies.parse_json_replies(reply(spark, text), list(ROLES))
    assert [(r.kind, r["size"], r.price) for r in got.collect()] == rows


def test_exact_wants_no_further_keys(spark):
    text = '{"kind": "red", "size": 5, "price": 7.5, "more": 1}'
    assert replies.parse_json_replies(reply(spark, text), list(ROLES), exact=True).count() == 0


def test_long_broken_reply_is_fast(spark):
    """A pattern that backtracks would not come back from this."""
    text = "{" + '"a": 1, ' * 20000 + "'b"
    assert replies.parse_json_replies(reply(spark, text, text + "}"), ["a"]).count() == 0


def test_empty_reply_and_null(spark):
    df = spark.createDataFrame([(0, ""), (1, None)], "chat_id bigint, response string")
    assert replies.parse_csv_replies(df, list(ROLES)).count() == 0
    assert replies.parse_json_replies(df, list(ROLES)).count() == 0


def test_accepted_and_rejected_are_complementary(spark, tables):
    parsed = replies.parse_csv_replies(reply(spark, "red,5,7.5\nred,999,7.5"), list(ROLES))
    checked = replies.validate_rows(parsed, tables.numeric, tables.dictionary, ROLES)
    assert replies.accepted(checked).count() == 1 and replies.rejected(checked).count() == 1
    first = replies.accepted(checked).first()
    assert (first.kind, first["size"], first.price) == (0, 5, 7.5)
    assert replies.accepted(checked).schema["kind"].dataType.simpleString() == "bigint"


def test_carriage_returns_are_stripped(spark):
    got = replies.parse_csv_replies(reply(spark, "red,\t5 ,7.5\r\nred,6,8\r"), list(ROLES)).orderBy("position").collect()
    assert [(r["size"], r.price) for r in got] == [("5", "7.5"), ("6", "8")]


def test_braces_inside_of_texts(spark):
    """A brace in a text does not end an object; one without its quote does not swallow the next object."""
    text = 'x {"a": "x {y}", "b": 1} and {\'a\': "}", "b": 2} {"a": "open, {"a": "z", "b": 3}'
    df = spark.createDataFrame([(1, text)], "chat_id bigint, response string")
    rows = replies.parse_json_replies(df, ["a", "b"]).orderBy("b").collect()
    assert [(r.a, r.b) for r in rows] == [("x {y}", "1"), ("}", "2"), ("z", "3")]
    assert replies.normalise_reply(df).first().response.count("\n") == 2
