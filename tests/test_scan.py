"""Block-wise scans equal the plain windows, whatever the block width, also with one dominating key."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.scan import carry_forward_by_block, lag_by_block, running_sum_by_block

BLOCKS = ["1 minute", "1 hour", "3 days", "4000 days"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(600):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(6)}"
        # Clustered times with long gaps, and times shared by several rows.
        at = start + timedelta(days=rnd.choice([0, 0, 1, 9, 40]), seconds=rnd.randrange(0, 7200, 3))
        out.append((key, at, i, rnd.choice([None, rnd.randrange(100)]), rnd.random()))
    return spark.createDataFrame(out, "key string, ts timestamp, tie int, a int, b double").persist()


@pytest.mark.parametrize("block", BLOCKS)
def test_lag(data, block):
    w = W.partitionBy("key").orderBy("ts", "tie")
    want = data.select("*", F.lag("a").over(w), F.lag("b").over(w))
    assert rows(lag_by_block(data, ["key"], "ts", ["a", "b"], block, ["tie"])) == rows(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_running_sum(data, block):
    w = W.partitionBy("key").orderBy("ts", "tie").rowsBetween(W.unboundedPreceding, 0)
    want = data.select("*", F.sum("a").over(w), F.sum("tie").over(w))
    assert rows(running_sum_by_block(data, ["key"], "ts", ["a", "tie"], block, ["tie"])) == rows(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_carry_forward(data, block):
    w = W.partitionBy("key").orderBy("ts", "tie").rowsBetween(W.unboundedPreceding, -1)
    want = data.select("*", F.last("a", True).over(w))
    assert rows(carry_forward_by_block(data, ["key"], "ts", ["a"], block, ["tie"])) == rows(want)


def test_hot_key_is_spread_over_blocks(data):
    plan = lag_by_block(data, ["key"], "ts", ["a"], "1 hour", ["tie"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "__block" in plan.split("hashpartitioning(key")[1].split(")")[0]


def test_carry_forward_computes_its_input_once(spark, tmp_path):
    """A parse in front of the scan runs once: the block ends read the rows that were shuffled for the windows."""
    spark.range(1000).selectExpr("""concat('{"k":"', id % 3, '","v":', id, '}') AS value""", "id").write.parquet(f"{tmp_path}/in")
    parsed = spark.read.parquet(f"{tmp_path}/in").select("id", F.from_json("value", "k string, v int").alias("r")) \
        .select("r.k", "r.v", "id").where("k IS NOT NULL")
    out = carry_forward_by_block(parsed, ["k"], "id", ["v"], 100)
    assert len(out.collect()) == 1000
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1 and final.count("FileScan") == 1
