"""Running a query in Spark and its SQL in DuckDB on the same tables."""

from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def in_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def in_duckdb(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())
