"""Runs a query and its SQL on the same tables and compares their rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    import pandas as pd

    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else (round(v, 6) if isinstance(v, float) else (int(v) if hasattr(v, "item") and not isinstance(v, str) and float(v) == int(v) else v)) for v in r))
    return sorted(out, key=repr)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    want, got = con.execute(sql).df(), query(spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns), (name, list(want.columns), list(got.columns))
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (name, len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    assert a == b, (name, [(x, y) for x, y in zip(a, b) if x != y][:3])
    return len(a), dict(got.dtypes), dict(want.dtypes)
