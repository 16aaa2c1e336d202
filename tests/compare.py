"""Rows of a Spark query and of DuckDB SQL in one form, so that they can be compared."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(records: list[dict]) -> list[tuple]:
    return sorted((tuple((k, plain(r[k])) for k in sorted(r)) for r in records), key=repr)


def spark_rows(df) -> list[tuple]:
    return rows([r.asDict(recursive=True) for r in df.collect()])


def oracle_rows(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows([dict(zip(names, r, strict=True)) for r in cur.fetchall()])
