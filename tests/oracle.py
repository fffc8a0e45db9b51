"""Runs a query in Spark and its SQL in DuckDB over one folder of tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T00:00:00", "")
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def both(spark, query, sql, folder):
    """Sorted rows of either side, columns by name."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    r = c.sql(sql)
    names, want = r.columns, r.fetchall()
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(value(x[k]) for k in order) for x in df.collect())
    return got, sorted(tuple(value(x[names.index(k)]) for k in order) for x in want)
