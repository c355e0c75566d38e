"""Every catalog query against its SQL oracle on the smallest tables."""

import math
import os

import pytest

from ruleloom.plans import oracle
from ruleloom.plans.catalog import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLE = oracle.statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, database, name):
    result = QUERIES[name](spark, FOLDER)
    relation = database.execute(ORACLE[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(result.columns)
    assert normal([tuple(r) for r in result.collect()], result.columns) == normal(relation.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns
