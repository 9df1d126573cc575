"""Runs a catalogue query and its SQL twin and compares their rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(body, key=repr)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def differences(got, want):
    """None if equal, else a short account."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=False) if g != w]
    return f"{len(got[1])} rows against {len(want[1])}; {len(bad)} differ; first {bad[:2]}"
