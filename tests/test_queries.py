import os

import duckdb
import pytest

import __spark_entry__ as entry
from bridgewell.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_other_queries_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
