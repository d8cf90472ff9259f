"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def connect(folder: str):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        source = path if path.is_file() else path / "*.parquet"
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark, run, sql: str, folder: str, db=None) -> str:
    """Empty where both give the same columns and rows; else what differs."""
    db = db or connect(folder)
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows against {len(want)}; only here {extra}; only in SQL {missing}"
