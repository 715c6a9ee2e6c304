import os

import duckdb
import pytest

import __spark_entry__ as entry
from sharegate.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


NAMES = {q.__name__ for q in QUERIES}  # the queries of sharegate.llm have tests of their own


def test_every_query_has_an_oracle():
    assert NAMES <= set(entry.queries()) and NAMES <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(columns).collect())))
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))
