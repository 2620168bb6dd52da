"""Compare a query with its DuckDB SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted([tuple(r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)], key=repr)


def same(spark, name, queries, sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.execute(sql[name]).df()
    got = queries[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return got
