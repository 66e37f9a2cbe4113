"""Compare a query with its SQL: same columns, same rows in any order, exact values."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int", "double": "float",
    "float": "float", "string": "str", "varchar": "str", "boolean": "bool",
}


def compare(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    want_rows = cur.fetchall()
    got_rows = df.collect()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for f in df.schema.fields:
        mine = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if mine != kinds[f.name]:
            problems.append(f"type of {f.name}: {mine} vs {kinds[f.name]}")
    if len(got_rows) != len(want_rows):
        problems.append(f"rows {len(got_rows)} vs {len(want_rows)}")
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    got = sorted(tuple(cell(row[n]) for n in order) for row in got_rows)
    want = sorted(tuple(cell(row[at[n]]) for n in order) for row in want_rows)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        problems.append(f"{len(a)} rows only here, {len(b)} only in SQL; {order}")
        problems += [f"  here {x}" for x in sorted(a)[:3]] + [f"  sql  {x}" for x in sorted(b)[:3]]
    return problems
