"""Licence scans: statements and licence files by TF-IDF cosine to templates, inherited along directories.

Only DataFrame functions are used. Texts are cut into statements (lines and sentences); the terms of the statements that
hold an anchor word are weighted like those of the templates and compared with them by a join on terms. Headers (leading
comments) and licence files are compared with header notices and whole licence texts too, as one vector each, by the idf of
the scanned files. SPDX identifiers are read as they are. A file that states no licence takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import col, saved
from tabweave.llm.licence_texts import whole_texts

LEAST_COSINE = 0.6
# The same for headers and licence files, whose vectors share most common words.
LEAST_WHOLE = 0.8

# Usual statements of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    # Both clauses open with it; the whole text tells which.
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
)
# Statements without one of these words are no licence statements; each template holds one.
ANCHOR = r"(?i)licen[cs]e|copyright|redistribut|permission|public domain|waived|unauthori[sz]ed copying|proprietary"
TERM = r"[a-z0-9]+"
# An SPDX tag and its first identifier; licences that have one.
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([A-Za-z0-9.+-]+)"
SPDX_LICENCES = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "ISC")
COMMENT_LINE = r"^\s*(#|//|/\*|\*|;|--|%|$)"
COMMENT_BLOCK = r"^\s*(?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"
ENDS = r"([.!?;])\s+"


def template_terms() -> tuple[list[tuple[int, str, str, float]], dict[str, float]]:
    """``(number, licence, term, weight)`` of all templates, weights of each of length one, and each term's idf."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for number, ((licence, _), found) in enumerate(zip(TEMPLATES, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in found.items()))
        rows += [(number, licence, t, n * idf[t] / norm) for t, n in sorted(found.items())]
    return rows, idf


def unknown_idf() -> float:
    """The idf of a term that no template has."""
    return math.log(1 + len(TEMPLATES)) + 1


def statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, statement)``: the lines and sentences with an anchor word, of whole texts."""
    lines = F.split(F.regexp_replace("text", ENDS, "$1\n"), "\n")
    rows = df.select(col(key).alias("key"), col(text).alias("text")).filter(F.col("text").rlike(ANCHOR))
    return rows.select("key", F.posexplode(lines).alias("place", "statement")).filter(F.col("statement").rlike(ANCHOR))


def statement_licences(found: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``(key, place, licence, score, tagged)``: the closest template of each statement, if its cosine is ``least`` or more."""
    spark = found.sparkSession
    tag = F.regexp_replace(F.lower(F.regexp_extract("statement", SPDX, 1)), r"(-only|-or-later|\+)$", "")
    # A tag names its licence, or one that is not listed; it is not compared.
    listed = F.create_map(*[F.lit(x) for name in SPDX_LICENCES for x in (name.lower(), name)])
    tags = found.filter(F.col("statement").rlike(SPDX)).select("key", "place", listed[tag].alias("licence"))
    found = found.filter(~F.col("statement").rlike(SPDX))
    rows, idf = template_terms()
    # The templates are fixed, so their tables are small whatever the input.
    templates = F.broadcast(spark.createDataFrame(rows, "number int, licence string, term string, weight double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    terms = found.select("key", "place", F.explode(F.regexp_extract_all(F.lower("statement"), F.lit(f"({TERM})"))).alias("term"))
    counts = terms.groupBy("key", "place", "term").agg(F.count("*").alias("n")).join(known, "term", "left")
    counts = counts.withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(unknown_idf())))
    norms = counts.groupBy("key", "place").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = counts.filter("idf IS NOT NULL").select("key", "place", "term", F.col("weight").alias("own")).join(templates, "term")
    dots = dots.groupBy("key", "place", "number", "licence").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["key", "place"]).withColumn("score", F.col("dot") / F.col("norm")).filter(F.round("score", 9) >= least)
    best = F.struct(F.round("score", 9).alias("score"), (-F.col("number")).alias("first"), "licence")
    closest = scored.groupBy("key", "place").agg(F.max(best).alias("best")).select("key", "place", "best.licence", "best.score", F.lit(False).alias("tagged"))
    return closest.unionByName(tags.filter("licence IS NOT NULL").select("key", "place", "licence", F.lit(1.0).alias("score"), F.lit(True).alias("tagged")))


def headers(rows: DataFrame) -> DataFrame:
    """``(key, place, whole)`` from ``(key, text, gives)``: the leading comment of each file and all of a licence file."""
    lines = F.split("text", "\n")
    ends = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT_LINE)), False)
    block = F.regexp_extract("text", COMMENT_BLOCK, 0)
    lead = F.when(block != "", block).otherwise(F.array_join(F.slice(lines, 1, F.when(ends == 0, F.size(lines)).otherwise(ends - 1).cast("int")), "\n"))
    stated = rows.filter(F.col("text").rlike(ANCHOR))
    parts = stated.select("key", F.posexplode(F.array(lead, F.when(F.col("gives"), F.col("text")))).alias("place", "whole"))
    return parts.filter(F.col("whole").rlike(ANCHOR)).select("key", F.struct("place", F.xxhash64("whole").alias("hash")).alias("place"), "whole")


def whole_licences(rows: DataFrame, least: float = LEAST_WHOLE) -> DataFrame:
    """``(key, licence, score)`` of headers and licence files from ``(key, text, gives)``.

    idf counts all ``rows``. Terms that no template has weigh as much as the mean of the others. Texts are read twice: for the
    files that hold each term, and for headers and licence files, whose terms are few and written once.
    """
    spark = rows.sparkSession
    texts = whole_texts()
    counts = [(n, licence, t, c) for n, (licence, text) in enumerate(texts) for t, c in sorted(Counter(re.findall(TERM, text.lower())).items())]
    # The templates are fixed, so their tables are small whatever the input.
    vocabulary = sorted({t for _, _, t, _ in counts})
    known = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    every = F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"))
    seen = rows.select(F.explode(F.array_distinct(every)).alias("term")).join(F.broadcast(known), "term").groupBy("term").agg(F.count("*").alias("df"))
    files = F.broadcast(rows.agg(F.count("*").alias("files")))
    # One row per term of the templates.
    idf = known.join(seen, "term", "left").crossJoin(files).select("term", (F.log((1 + F.col("files")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    idf = saved(idf.coalesce(1), "licence-idf")
    plain = F.broadcast(idf.agg(F.avg("idf").alias("plain")))
    templates = spark.createDataFrame(counts, "number int, licence string, term string, c int").join(F.broadcast(idf), "term")
    templates = templates.withColumn("weight", F.col("c") * F.col("idf"))
    lengths = templates.groupBy("number").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    templates = templates.join(F.broadcast(lengths), "number").select("number", "licence", "term", (F.col("weight") / F.col("length")).alias("weight"))
    terms = headers(rows).select("key", "place", F.explode(F.regexp_extract_all(F.lower("whole"), F.lit(f"({TERM})"))).alias("term"))
    counted = saved(terms.groupBy("key", "place", "term").agg(F.count("*").alias("n")), "licence-terms")
    own = counted.join(F.broadcast(idf), "term", "left").crossJoin(plain)
    own = own.withColumn("own", F.col("n") * F.coalesce("idf", "plain"))
    norms = own.groupBy("key", "place").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"))
    dots = own.filter("idf IS NOT NULL").select("key", "place", "term", "own").join(F.broadcast(templates), "term")
    dots = dots.groupBy("key", "place", "number", "licence").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["key", "place"]).select("key", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= least)
    return scored.groupBy("key").agg(F.max(F.struct("score", "licence")).alias("best")).select("key", "best.licence", "best.score")


def scan_licences(files: DataFrame, path: str, text: str, is_licence_file: Column, least: float = LEAST_COSINE) -> DataFrame:
    """``(path, own_licence, own_score, n_statements, inherited_licence, inherited_from, licence)`` per distinct path.

    ``own_licence`` is that of an SPDX identifier; else of the header or the licence file as a whole; else of the best
    statement of the whole text (ties: the alphabetically first licence). It is null if none is close enough; a copyright line
    or "all rights reserved" alone states no licence; null and empty texts state none. A licence file (``is_licence_file``, over the
    columns of ``files``) with an own licence gives it to its directory; of several in a directory the alphabetically first path
    counts. Other files inherit from the nearest directory at or above their own. ``licence`` is the own one, else the
    inherited one. Rows without a path are left out; rows that share a path are one file whose statements are taken
    together. Extra columns are left out.
    """
    rows = files.filter(col(path).isNotNull())
    listed = rows.groupBy(col(path).alias("key")).agg(F.max(F.coalesce(is_licence_file, F.lit(False))).alias("gives"))
    # Statements are few beside the texts: few files hold them, and each file starts processes that set its mode.
    stated = saved(_places(statements(rows, path, text)).hint("rebalance"), "licence-statements")
    found = saved(statement_licences(stated, least), "licence-statements")
    texts = rows.select(col(path).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"), F.coalesce(is_licence_file, F.lit(False)).alias("gives"))
    whole = saved(whole_licences(texts), "licence-wholes")
    rank = lambda n, value: F.struct(F.lit(n).alias("rank"), F.col("score")) if value is None else F.struct(value.alias("rank"), F.col("score"))
    every = found.select("key", "licence", rank(0, F.when(F.col("tagged"), 2).otherwise(0)).alias("order"), F.lit(1).alias("n"))
    every = every.unionByName(whole.select("key", "licence", rank(1, None).alias("order"), F.lit(0).alias("n")))
    top = every.groupBy("key").agg(F.max("order").alias("top"), F.sum("n").alias("n"))
    named = every.join(top, "key").filter("order = top").groupBy("key").agg(F.min("licence").alias("licence"), F.max("top.score").alias("score"), F.max(top["n"]).alias("n"))
    own = listed.join(named, "key", "left")
    directory = F.regexp_extract("key", r"^(.*)/[^/]*$", 1)
    givers = own.filter("gives AND licence IS NOT NULL").groupBy(directory.alias("directory")).agg(F.min(F.struct("key", "licence")).alias("giver"))
    # Directories are far fewer than files: ancestors are looked up once per directory.
    directories = listed.select(directory.alias("directory")).distinct()
    parts = F.split("directory", "/")
    levels = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    above = F.transform(levels, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(above, F.array(F.lit("")))))
    steps = directories.select("directory", F.posexplode(above).alias("steps", "ancestor"))
    nearest = steps.join(givers.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.min(F.struct("steps", "giver.licence", "ancestor")).alias("near"))
    joined = own.withColumn("directory", directory).join(nearest, "directory", "left")
    return joined.select(
        F.col("key").alias(path),
        F.col("licence").alias("own_licence"),
        F.col("score").alias("own_score"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_statements"),
        F.when(F.col("licence").isNull(), F.col("near.licence")).alias("inherited_licence"),
        F.when(F.col("licence").isNull(), F.col("near.ancestor")).alias("inherited_from"),
        F.coalesce("licence", "near.licence").alias("licence"),
    )


def _places(found: DataFrame) -> DataFrame:
    """Statements numbered by place and hash, so that files that share a path keep theirs apart."""
    return found.select("key", F.struct("place", F.xxhash64("statement").alias("hash")).alias("place"), "statement")

