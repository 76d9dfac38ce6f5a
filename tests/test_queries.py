"""Every engine query against DuckDB, where the driver's tables are at hand."""

import os

import duckdb
import pytest

from strandline.plans.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF_DIR}/documents.parquet"), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return db


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    wanted = duck.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in wanted.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in found.collect()) == expected
