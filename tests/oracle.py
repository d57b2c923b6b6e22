"""Compare every query that has an oracle with DuckDB on the same tables."""

import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "~" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows), sorted(names)


def same(spark, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want = normal(cur.fetchall(), [d[0] for d in cur.description])
    return got == want, (len(got[0]), len(want[0]), got[0][:2], want[0][:2], got[1], want[1])
