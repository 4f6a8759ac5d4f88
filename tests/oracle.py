"""Run registered queries on Spark and DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, f"{value:+030.9f}" if not math.isinf(value) else str(value))
    return (3, str(value))


def _rows(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r])


def compare(spark_df, con, sql: str) -> list[str]:
    problems = []
    rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]) for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    mine = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    for name, kind in zip(names, kinds):
        if TYPES.get(mine[name], mine[name]) != kind:
            problems.append(f"type of {name}: {mine[name]} vs {kind}")
    columns = sorted(names)
    left = _rows(rows, [spark_df.columns.index(c) for c in columns])
    right = _rows(expected, [names.index(c) for c in columns])
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ; columns {columns}; first {bad[0][0]} vs {bad[0][1]}")
    if not right:
        problems.append("both results are empty")
    return problems


def main() -> None:
    from tokentally.plans import registry
    from tokentally.runtime import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    registry.load()
    wanted = [a for a in sys.argv[2:] if a != "-v"]
    modules = {w[1:] for w in wanted if w.startswith("@")}
    names = [n for n in registry.QUERIES if not wanted or n in wanted or registry.HOMES[n] in modules]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            if name in registry.ORACLES:
                problems = compare(df, con, registry.ORACLES[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report every query, then fail
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        mark = "ok  " if not problems else "FAIL"
        if problems or time.time() - start > 6 or "-v" in sys.argv:
            print(mark, name, f"{time.time() - start:.1f}s", *problems, sep="  ", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree", flush=True)


if __name__ == "__main__":
    main()
