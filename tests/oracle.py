"""Runs a registered query and its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir), con.execute(sql)
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = lambda x: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in x), key=repr)
    a, b = rows(tuple(r[n] for n in names) for r in got.collect()), rows(tuple(r[i] for i in order) for r in want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
