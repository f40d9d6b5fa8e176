"""Compare a query with its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def same(value: object) -> str:
    """A value as text; doubles in fewer digits than the queries round to, so that a tie in rounding may fall either way."""
    if isinstance(value, (list, dict, np.ndarray)):
        return str(value)
    if pd.isna(value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return str(value)


def number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)) and not pd.isna(value) else None


def rows(df: pd.DataFrame) -> list[tuple[object, ...]]:
    """Rows in an order that small differences of doubles do not change, as far as other columns tell rows apart."""
    df = df[sorted(df.columns)].astype(object)
    out = [tuple(x if (x := number(v)) is not None else same(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=lambda r: ([f"{v:.4g}" if isinstance(v, float) and v % 1 else str(v) for v in r], [str(v) for v in r]))


def close(a: object, b: object) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2.1e-7) if isinstance(a, float) and isinstance(b, float) else a == b


def assert_matches(spark, query, sql: str, folder: str = SMALL) -> None:
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, expected = query(spark, folder).toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    left, right = rows(got), rows(expected)
    assert len(left) == len(right)
    wrong = [(x, y) for x, y in zip(left, right) if not all(map(close, x, y))]
    assert not wrong, wrong[:3]
