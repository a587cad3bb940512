"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from gristmill.plans.oracles import ORACLES
from gristmill.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = plain(tuple(r) for r in found.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    expected = tables.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert rows == plain(expected)
