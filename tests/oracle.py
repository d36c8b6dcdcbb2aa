"""Run registered queries in Spark and their SQL twins in DuckDB, and compare.

``python -m tests.oracle [sf folder] [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, fn, sql, folder) -> list[str]:
    """Differences between a query and its SQL twin; empty when they agree."""
    df = fn(spark, folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    want = found.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    duck_kinds = dict(zip(names, [str(t) for t in con.sql(sql).types]))
    for field in df.schema.fields:
        simple = field.dataType.simpleString()
        mine = _KINDS.get(simple, simple.upper().replace("(", "(").replace(" ", ""))
        other = duck_kinds[field.name].replace(" ", "")
        if mine != other:
            problems.append(f"type of {field.name}: {mine} != {other}")
    a, b = _rows(df.columns, df.collect()), _rows(names, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        problems.append(f"values differ\n   spark {only_a}\n   sql   {only_b}")
    if not a:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in oracle:
                problems = compare(spark, con, queries[name], oracle[name], folder)
            else:
                problems = [] if queries[name](spark, folder).count() else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", *problems, sep="\n   " if problems else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
