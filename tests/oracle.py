"""Run a registered query and its SQL twin, and compare rows regardless of order."""

from __future__ import annotations

import math

import duckdb

SF_DIR = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
}


def spark_rows(df):
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, [KIND.get(kinds[n], kinds[n]) for n in names], _sorted(rows)


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [(d[0], str(d[1]).lower()) for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    kinds = [KIND.get(columns[i][1], columns[i][1]) for i in order]
    return [columns[i][0] for i in order], kinds, _sorted(rows)


def compare(spark_side, duck_side) -> str | None:
    """None when equal, else what differs."""
    names_a, kinds_a, a = spark_side
    names_b, kinds_b, b = duck_side
    if names_a != names_b:
        return f"columns {names_a} / {names_b}"
    if kinds_a != kinds_b:
        return f"types {list(zip(names_a, kinds_a, kinds_b))}"
    if len(a) != len(b):
        return f"row counts {len(a)} / {len(b)}: {a[:2]} / {b[:2]}"
    for left, right in zip(a, b):
        if left != right:
            return f"values {names_a}: {left} / {right}"
    return None
