"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
import oracles  # noqa: E402
from tidewire.plans import queries as plans  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = plans.QUERIES, oracles.ORACLES
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP",
         "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("query", sorted(QUERIES))
def test_query(spark, sql, query):
    df = QUERIES[query](spark, SF)
    want = sql.execute(ORACLES[query])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    assert kinds == {d[0]: str(d[1]) for d in want.description}
    got = sorted(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    assert got == sorted(tuple(normal(v) for v in r) for r in want.fetchall())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["time", "measurement", "serial_number"] and df.count() > 0
