"""Spark rows against DuckDB rows, as multisets of values by column name."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def differences(df, sql: str, sf_dir: str) -> str:
    names = sorted(df.columns)
    found = connection(sf_dir).execute(sql)
    order = [d[0] for d in found.description]
    if sorted(order) != names:
        return f"columns {names} and {sorted(order)}"
    theirs = Counter(tuple(plain(row[order.index(n)]) for n in names) for row in found.fetchall())
    ours = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark: {list((ours - theirs).items())[:2]}; only SQL: {list((theirs - ours).items())[:2]}"
