"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.6f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, sf_dir, threads=2):
    con = duckdb.connect(config={"threads": threads})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())
