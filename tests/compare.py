"""Run one registered query and its SQL on the same tables and compare all values."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns))


def kinds_of(table: pa.Table) -> dict[str, str]:
    def plain(t: pa.DataType) -> str:
        return "string" if pa.types.is_large_string(t) else str(t)

    return {n: plain(table.schema.field(n).type) for n in sorted(table.column_names)}


def compare(spark_table: pa.Table, con, sql: str) -> list[str]:
    oracle = con.sql(sql).to_arrow_table()
    problems = []
    if kinds_of(spark_table) != kinds_of(oracle):
        problems.append(f"schema: {kinds_of(spark_table)} / {kinds_of(oracle)}")
    if sorted(spark_table.column_names) != sorted(oracle.column_names):
        return problems
    ours, theirs = rows_of(spark_table), rows_of(oracle)
    if len(ours) != len(theirs):
        problems.append(f"rows: {len(ours)} / {len(theirs)}")
    mine, other = Counter(ours) - Counter(theirs), Counter(theirs) - Counter(ours)
    if mine or other:
        problems.append(f"values ({len(mine)}): {sorted(mine)[:3]} / {sorted(other)[:3]}")
    return problems
