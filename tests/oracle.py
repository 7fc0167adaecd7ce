"""Compare catalogue queries with their SQL run by DuckDB.

Command line: ``python -m tests.oracle <sf_dir> [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if "int" in name or name in ("long", "short", "byte"):
        return "integer"
    if name in ("string", "varchar"):
        return "string"
    return name


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(df, con, sql: str) -> list[str]:
    """Differences in schema, row count and values; empty if the same."""
    got_names, got_types = df.columns, [f.dataType.typeName() for f in df.schema.fields]
    got = [tuple(row) for row in df.collect()]
    cur = con.execute(sql)
    want_names, want_types = [c[0] for c in cur.description], [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} != {sorted(want_names)}"]
    types = dict(zip(want_names, want_types))
    for name, kind in zip(got_names, got_types):
        if _kind(kind) != _kind(types[name]):
            problems.append(f"type of {name}: {kind} != {types[name]}")
        elif _kind(kind) == "integer" and {kind, types[name].lower()} not in (
                {"long", "bigint"}, {"integer"}):
            problems.append(f"width of {name}: {kind} != {types[name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(got_names, got), _rows(want_names, want)
    for x, y in zip(a, b):
        if repr(x) != repr(y):  # also tells -0.0 from 0.0
            problems.append(f"first difference over {sorted(got_names)}:\n  spark  {x}\n  duckdb {y}")
            break
    return problems


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from trajlake.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con = connect(sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            problems = compare(df, con, oracles[name]) if name in oracles else [] if df.count() else ["no rows"]
        except Exception as exc:  # noqa: BLE001 - report and go on
            problems = [f"{type(exc).__name__}: {str(exc)[:1200]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{name:28}{time.time() - start:7.2f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print(f"{bad} failing")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
