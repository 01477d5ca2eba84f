"""Compare a registered query with its SQL in DuckDB on the same Parquet tables."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def expected(sql: str, folder: str = SF):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), sorted(repr([norm(dict(zip(names, r, strict=True))[n]) for n in sorted(names)]) for r in found.fetchall())


def actual(df):
    names = sorted(df.columns)
    return names, sorted(repr([norm(r[n]) for n in names]) for r in df.collect())
