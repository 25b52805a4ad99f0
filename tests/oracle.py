"""Run a query and its SQL over the same tables and compare all values."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        found.execute(f"create view {name} as select * from '{path}'")
    return found


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return float(x)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    found = [tuple(map(_value, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)]
    return sorted(found, key=str)


def same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) == len(wanted)
    for a, b in zip(rows(got), rows(wanted), strict=True):
        assert a == b
