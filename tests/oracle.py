"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)


def duck_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def same(df, sql, folder):
    names, expected = duck_rows(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(names, [r.asDict() for r in df.collect()])
    assert got == rows_of(names, expected)
    return got
