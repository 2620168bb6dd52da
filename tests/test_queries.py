"""Every query with SQL against DuckDB on the small tables."""

import datetime
import math

import duckdb
import pytest

from tidemark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, datetime.datetime):
        return x.date()
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def db(small):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, db, name):
    got = queries.queries()[name](spark, small)
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == want
    assert want or name in ("agg18_duplicates", "set05_month_gaps")


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_give_rows(spark, small, name):
    assert queries.queries()[name](spark, small).count() >= 1
