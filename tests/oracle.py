"""Spark results against the registered SQL on the small tables, as the driver compares them."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir=SF_DIR):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return repr(v) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
