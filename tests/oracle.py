"""Side by side: a query's rows by Spark and by its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.01"


def by_sql(sql: str, sf_dir: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone = 'UTC'")
    return con.execute(sql).fetchdf()


def _cell(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 5)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    out = [tuple(_cell(v) for v in r) for r in df[names].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, bool) else int(x)) if not isinstance(x, float) else (False, "n", x) for x in r))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {a[:2]} {b[:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if any(p != q and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y))]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
