"""Comparison of a query's rows with DuckDB's."""

from __future__ import annotations

import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canonical(value) -> str:
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def rows(found: list, columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canonical(r[i]) for i in order) for r in found)
