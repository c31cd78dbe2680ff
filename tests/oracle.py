"""Compares a DataFrame with the rows of SQL that another engine runs on the same tables."""

from collections import Counter

from glyphgrid.sources.bindings import TABLES


def _plain(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    return "null" if v is None else str(v)


def compare(duckdb, df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
