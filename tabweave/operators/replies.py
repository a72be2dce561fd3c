"""Model replies back into typed rows: CSV and JSON extraction, repair, validation.

Replies are ``(chat_id, response)`` rows. Everything is a regular expression or a JSON function of the JVM; the patterns
cannot backtrack, so no reply needs a time limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import lookup, one_row
from tabweave.operators.dictionary import dictionary_sizes
from tabweave.roles import Roles, cat_cols, cont_cols

# What counts as an object, a flat object and a number in a reply.
# An object ends at the first closing brace outside of a quoted text; texts may hold braces.
OBJECT = r"""(\{(?:[^{}"']++|"[^"]*+"|'[^']*+')*+\})"""
FLAT_OBJECT = r'^\{(?:\s*+"[^"]*+"\s*+:\s*+(?:"[^"]*+"|-?+\d++(?:\.\d++)?+)\s*+,?+)++\s*+\}$'
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _clean(value: Column) -> Column:
    return F.btrim(F.translate(value, "'\"", ""), F.lit(" \t\r\n\f\x0b"))


def parse_csv_replies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(chat_id, position, cols...)`` of the lines with the right number of commas, as unquoted text."""
    lines = df.select("chat_id", F.posexplode(F.split("response", "\n")).alias("position", "line"))
    fields = F.split(F.regexp_replace("line", ",+$", ""), ",")
    rows = lines.withColumn("_f", fields).filter(F.size("_f") == len(cols))
    return rows.select("chat_id", "position", *[_clean(F.col("_f")[i]).alias(c) for i, c in enumerate(cols)])


def drop_leading_zeros(text: Column) -> Column:
    """Drop the zeros in front of a whole number; decimals such as 0.05 stay as they are."""
    return F.regexp_replace(text, r"(?<![\w.])0+(?=\d)", "")


def extract_json_objects(df: DataFrame) -> DataFrame:
    """``(chat_id, position, object)`` of every flat ``{...}`` in a reply."""
    found = F.regexp_extract_all(drop_leading_zeros(F.col("response")), F.lit(OBJECT), F.lit(1))
    return df.select("chat_id", F.posexplode(found).alias("position", "object"))


def repair_json(text: Column) -> Column:
    """Double quotes, no line breaks, commas between members, none before a closing bracket."""
    text = F.translate(text, "'\n\r", '"')
    text = F.regexp_replace(text, r'(?<=[}\]\d"])\s*+(?="\w)', ",")
    return F.regexp_replace(text, r",\s*+(?=[}\]])", "")


def parse_json_replies(df: DataFrame, cols: Sequence[str], exact: bool = False) -> DataFrame:
    """``(chat_id, position, cols...)`` of the objects that have every column, as unquoted text.

    ``exact`` asks for these keys and no others. Decimal numbers come out as JSON reads them, as doubles.
    """
    found = F.regexp_extract_all(drop_leading_zeros(F.col("response")), F.lit(OBJECT), F.lit(1))
    # Parsed inside the array, before the explode: a filter on a parsed column would repeat the parse per condition.
    parsed = F.transform(
        F.transform(found, repair_json), lambda o: F.when(o.rlike(FLAT_OBJECT), F.from_json(o, "map<string,string>"))
    )
    members = df.select("chat_id", F.posexplode(parsed).alias("position", "_m"))
    wanted = F.lit(True)
    for c in cols:
        wanted = wanted & F.map_contains_key("_m", c)
    if exact:
        wanted = wanted & (F.size("_m") == len(cols))
    rows = members.filter(F.col("_m").isNotNull()).filter(wanted)
    return rows.select("chat_id", "position", *[_clean(F.col("_m")[c]).alias(c) for c in cols])


def normalise_reply(df: DataFrame) -> DataFrame:
    """``(chat_id, response)`` with only the parseable objects of each reply, repaired, one per line."""
    found = F.regexp_extract_all(drop_leading_zeros(F.col("response")), F.lit(OBJECT), F.lit(1))
    repaired = F.transform(found, repair_json)
    kept = F.filter(
        repaired, lambda o: o.rlike(FLAT_OBJECT) & F.from_json(o, "map<string,string>").isNotNull()
    )
    return df.select("chat_id", F.array_join(kept, "\n").alias("response"))


def validate_rows(
    df: DataFrame, profile: DataFrame, dictionary: DataFrame, roles: Roles, sizes: dict[str, int] | None = None
) -> DataFrame:
    """Type and check parsed rows; ``reason`` names the first failing column and is null for an accepted row.

    Numbers must parse and lie between the profiled extremes (ints truncate first); categories must be in the
    dictionary and become codes.
    """
    sizes = dictionary_sizes(dictionary) if sizes is None else sizes
    conts, cats = cont_cols(roles), cat_cols(roles)
    reasons = []
    out = df
    if conts:
        bounds = one_row(
            profile.agg(
                *[F.max(F.when(F.col("column") == c, F.col("min"))).alias(f"lo{i}") for i, c in enumerate(conts)],
                *[F.max(F.when(F.col("column") == c, F.col("max"))).alias(f"hi{i}") for i, c in enumerate(conts)],
            )
        )
        for i, c in enumerate(conts):
            text = F.col(f"`{c}`").cast("string")
            number = F.when(text.rlike(NUMBER), text.try_cast("double"))
            out = out.withColumn(c, number.try_cast("bigint") if roles[c] == "int" else number)
            value = F.col(f"`{c}`")
            inside = (value >= bounds[f"lo{i}"]) & (value <= bounds[f"hi{i}"])
            reasons += [
                F.when(value.isNull(), F.lit(f"{c}: not a number")),
                F.when(~inside, F.lit(f"{c}: out of range")),
            ]
    for c in cats:
        out = lookup(out, c, dictionary.filter(F.col("column") == c), "value", "code", c, sizes.get(c, 0), "n")
        reasons.append(F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: unknown category")))
    return out.withColumn("reason", F.coalesce(*reasons))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())
