"""Compare a query with its SQL on DuckDB."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
    return con


def rows(frame: pd.DataFrame):
    """Rows as sorted tuples, columns by name, missing values as None. pandas makes floats of whole numbers beside missing ones; these are whole numbers again."""
    frame = frame[sorted(frame.columns)]
    lost = [c for c in frame.columns if frame[c].dtype.kind == "f" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all()]
    frame = frame.astype({c: "Int64" for c in lost})
    frame = frame.astype(object).where(frame.notna(), None)
    return list(frame.columns), sorted(map(repr, frame.itertuples(index=False, name=None)))
