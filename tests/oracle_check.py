"""Run queries beside their SQL in DuckDB: ``python -m tests.oracle_check [sf_dir] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(rows, order):
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    rel = con.sql(sql)
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    problems = []
    for f in spark_df.schema.fields:
        ours, theirs = SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()), kinds[names.index(f.name)]
        if ours != theirs:
            problems.append(f"type of {f.name}: {ours} against {theirs}")
    cols = sorted(names)
    got = _rows([tuple(x) for x in spark_df.collect()], [spark_df.columns.index(c) for c in cols])
    want = _rows(rel.fetchall(), [names.index(c) for c in cols])
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    differing = [(a, b) for a, b in zip(got, want) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {cols}: {differing[0][0]} against {differing[0][1]}")
    if not got:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tabweave.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.count() else ["no rows"])
        except Exception as e:  # noqa: BLE001 - report and go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        state = "FAIL" if problems else "ok" if name in oracles else "ok (rows only)"
        print(f"{state:15} {name:40} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("    ", p[:1600], flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
