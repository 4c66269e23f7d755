"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (int, float)):
        number = float(value)
        return "NaN" if math.isnan(number) else number + 0.0
    try:
        return float(value)
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    table.sort(key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))
    return [columns[i] for i in order], table


def difference(query, sql: str, spark, con, sf_dir: str, tolerance: float = 0.0) -> str | None:
    """None when equal, else a short description."""
    frame = query(spark, sf_dir)
    names, mine = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    other_names, theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns: only spark {set(names) - set(other_names)}, only sql {set(other_names) - set(names)}"
    if len(mine) != len(theirs):
        return f"rows: spark {len(mine)}, sql {len(theirs)}"
    bad = []
    for a, b in zip(mine, theirs):
        for name, x, y in zip(names, a, b):
            if x == y:
                continue
            close = isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1.0, abs(x))
            if not close:
                bad.append((name, x, y, a))
    return f"{len(bad)} cells, first {bad[0]}" if bad else None
