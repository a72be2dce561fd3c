from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabweave.llm import licences as lc


def cosines(statement):
    counts = [Counter(re.findall(lc.TERM, t.lower())) for _, t in lc.TEMPLATES]
    seen = Counter(t for c in counts for t in c)
    idf = lambda t: math.log((1 + len(counts)) / (1 + seen.get(t, 0))) + 1 if seen.get(t) else lc.unknown_idf()
    own = {t: n * idf(t) for t, n in Counter(re.findall(lc.TERM, statement.lower())).items()}
    norm = math.sqrt(sum(v * v for v in own.values()))
    out = []
    for (name, _), c in zip(lc.TEMPLATES, counts):
        theirs = {t: n * idf(t) for t, n in c.items()}
        dot = sum(own.get(t, 0) * v for t, v in theirs.items())
        out.append((dot / norm / math.sqrt(sum(v * v for v in theirs.values())), name))
    return out


def scan(spark, rows, gives="licence_file"):
    df = spark.createDataFrame(rows, "path string, text string, licence_file boolean")
    return {r.path: r for r in lc.scan_licences(df, "path", "text", F.col(gives)).collect()}


def test_every_template_is_found_and_prose_is_not(spark):
    rows = [(f"t/{i}", f"Some text before.\n{text}\nAnd some more after it.", False) for i, (_, text) in enumerate(lc.TEMPLATES)]
    rows += [("p/1", "A licence to drive a car is needed in most places, said the officer at the gate.", False), ("p/2", "Nothing of the kind", False)]
    got = scan(spark, rows)
    for i, (name, _) in enumerate(lc.TEMPLATES):
        assert got[f"t/{i}"].own_licence == name
    assert got["p/1"].own_licence is None and got["p/2"].own_licence is None


def test_scores_against_brute_force(spark):
    statements = ["Licensed under the Apache License 2.0", "This work is licensed under the GNU GPL, version 3", "Released under the MIT licence by us", "Copyright 2020. All rights reserved"]
    df = spark.createDataFrame([(str(i), 0, s) for i, s in enumerate(statements)], "key string, place int, statement string")
    got = {r.key: r for r in lc.statement_licences(df, 0.1).collect()}
    for i, s in enumerate(statements):
        score, _ = max(cosines(s))
        assert got[str(i)].score == pytest.approx(score, abs=1e-8)
        assert got[str(i)].licence in {n for c, n in cosines(s) if c > score - 1e-8}


def test_nearest_ancestor(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", mit, True), ("a/LICENSE", apache, True), ("a/x.py", "code", False), ("a/b/c/y.py", "code", None), ("d/z.py", "code", False),
        ("d/own.py", f"code\n{apache}", False), ("e/LICENSE", "no licence we know of", True), ("e/f.py", None, False), ("a/b/NOTICE", mit, False), ("q", "", False),
        ("a/ALICENSE", mit, True),
    ]
    got = scan(spark, rows)
    assert (got["a/x.py"].licence, got["a/x.py"].inherited_from) == ("MIT", "a")  # the alphabetically first of two files
    assert got["a/b/c/y.py"].inherited_from == "a" and got["d/z.py"].licence == "MIT" and got["d/z.py"].inherited_from == ""
    assert got["d/own.py"].licence == "Apache-2.0" and got["d/own.py"].inherited_licence is None
    assert got["e/f.py"].licence == "MIT" and got["a/b/NOTICE"].own_licence == "MIT" and got["q"].licence == "MIT"
    assert len(got) == len(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.", 1), ("a", None, 2), ("a", "Released under the MIT License.", 3)], "path string, text string, licence int")
    rows = lc.scan_licences(df, "path", "text", F.lit(False)).collect()
    assert [(r.path, r.licence, r.n_statements) for r in rows] == [("a", "MIT", 1)]
    assert lc.scan_licences(df.limit(0), "path", "text", F.lit(True)).count() == 0


def test_headers_files_and_identifiers(spark):
    from tabweave.llm.licence_texts import _gnu, whole_texts

    def wrapped(text, mark):
        words = text.split()
        return "\n".join(mark + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))

    rows = [(f"spdx/{name}", f"# SPDX-License-Identifier: {name}\ncode", False) for name in lc.SPDX_LICENCES]
    rows += [("spdx/GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0-only", False), ("spdx/none", "// SPDX-License-Identifier: Zlib", False)]
    rows += [(f"w{i}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + wrapped(text, ""), True) for i, (_, text) in enumerate(whole_texts())]
    rows += [(f"h{v}/a.c", wrapped(_gnu("General Public License", v).replace("software:", "software;").replace("tion, either", "tion; either"), " * ") + "\nint main;", False) for v in "23"]
    rows += [("s/cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", False)]
    rows += [(f"x/{i}", "Plain text about the terms of this and that software and its use in the world.", False) for i in range(30)]
    got = {p: r.own_licence for p, r in scan(spark, rows).items()}
    assert {n: got[f"spdx/{n}"] for n in lc.SPDX_LICENCES} == {n: n for n in lc.SPDX_LICENCES}
    assert got["spdx/GPL-2.0-only"] == "GPL-2.0" and got["spdx/none"] is None
    assert [got[f"w{i}/LICENSE"] for i in range(len(whole_texts()))] == [n for n, _ in whole_texts()]
    assert (got["h2/a.c"], got["h3/a.c"], got["s/cc"], got["x/1"]) == ("GPL-2.0", "GPL-3.0", "CC-BY-SA-4.0", None)


def test_families_quoted_headers_and_reserved_rights(spark):
    from tabweave.llm.licence_texts import whole_texts

    texts = dict(whole_texts())
    paragraphs = lambda name: "Copyright (c) 2020, Some Body. All rights reserved.\n\n" + re.sub(r"([.:;]) ", r"\1\n\n", texts[name])
    mit = "Released under the MIT License."
    rows = [(f"{name}/LICENSE", paragraphs(name), True) for name in ("BSD-2-Clause", "BSD-3-Clause")]
    rows += [(f"quoted/{i}.py", f"{q}\n{texts['BSD-2-Clause']}\n{q}\nimport os\n", False) for i, q in enumerate(("\"\"\"", "'''"))]
    rows += [("m/LICENSE", mit, True), ("m/a.c", "// Copyright X. All rights reserved.\n// More code below.\nint main;", False)]
    rows += [("p/x", "The publisher said: all rights reserved. Nobody minds.", False), ("own/x", "Unauthorized copying of this file, via any medium, is strictly prohibited", False)]
    rows += [("deep/LICENSE", mit, True), ("deep/" + "d/" * 150 + "x", "code", False)]
    got = scan(spark, rows)
    assert {n: got[f"{n}/LICENSE"].own_licence for n in ("BSD-2-Clause", "BSD-3-Clause")} == {n: n for n in ("BSD-2-Clause", "BSD-3-Clause")}
    assert [got[f"quoted/{i}.py"].own_licence for i in (0, 1)] == ["BSD-2-Clause"] * 2
    assert (got["m/a.c"].own_licence, got["m/a.c"].licence) == (None, "MIT") and got["p/x"].licence is None and got["own/x"].licence == "Proprietary"
    assert got["deep/" + "d/" * 150 + "x"].inherited_from == "deep"


def test_texts_are_read_three_times(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b", "x")], "path string, text string").write.parquet(path)
    df, reads = spark.read.parquet(path), []
    real = lc.saved

    def counted(frame, name):
        reads.append(frame._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<path:string,text:string>"))
        return real(frame, name)

    lc.saved = counted
    try:
        last = lc.scan_licences(df, "path", "text", F.col("path").endswith("LICENSE"))
        reads.append(last._jdf.queryExecution().executedPlan().toString().count("struct<path:string,text:string>"))
    finally:
        lc.saved = real
    assert sum(reads) <= 3


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "x")], "path string, text string")
    plan = lc.scan_licences(df, "path", "text", F.lit(False))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    from tabweave.llm.queries import op5_licences

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = []
        for s in re.sub(lc.ENDS, "\\1\n", r.text or "", flags=re.A).split("\n"):
            if re.search(lc.ANCHOR, s):
                score = round(max(cosines(s))[0], 9)
                if score >= lc.LEAST_COSINE:
                    found.append((score, s))
        top = max((s for s, _ in found), default=None)
        want[r.doc_id] = (len(found), min((max((c, -i, n) for i, (c, n) in enumerate(cosines(s)))[2] for v, s in found if v == top), default=None))
    got = {r.doc_id: (r.n_statements, r.own_licence) for r in op5_licences(spark, sf).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 5


def test_few_statements_take_few_files(spark, monkeypatch):
    from tabweave.llm import common

    written = []

    def saved(df, name):
        out = common.saved(df, name)
        written.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(lc, "saved", saved)
    rows = spark.range(64).selectExpr("concat('a/', id) path", "'Released under the MIT License.' text", "false gives").repartition(32)
    assert {r.own_licence for r in lc.scan_licences(rows, "path", "text", F.col("gives")).collect()} == {"MIT"}
    assert written[0][0] == "licence-statements" and written[0][1] <= 4
