"""Runs queries beside their SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """An empty string, or what differs."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    found = database(sf_dir).sql(sql)
    at = [found.columns.index(n) for n in names] if sorted(found.columns) == names else None
    if at is None:
        return f"columns {names} and {sorted(found.columns)}"
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    if ours == theirs:
        return ""
    return f"{len(ours)} and {len(theirs)} rows; only ours: {[r for r in ours if r not in theirs][:3]}; only SQL's: {[r for r in theirs if r not in ours][:3]}"


def scale() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
