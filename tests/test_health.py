import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewire.operators import health


@pytest.mark.parametrize("preset,cases", [
    ("cache_hit:summary", {99.5: "healthy", 99.0: "warning", 95.0: "warning", 94.9: "critical"}),
    ("cache_hit:detail", {99.0: "excellent", 95.0: "good", 90.0: "fair", 89.9: "poor"}),
    ("cache_hit:alert", {84.9: "critical", 85.0: "warning", 95.0: "ok"}),
    ("dead_pct:summary", {4.9: "healthy", 5.0: "warning", 10.0: "warning", 10.1: "critical"}),
    ("dead_pct:alert", {10.0: "ok", 10.1: "warning", 20.0: "warning", 20.1: "critical"}),
    ("sensor_lag:detail", {4.9: "healthy", 5.0: "warning", 15.0: "critical", 45.0: "critical", 60.1: "offline"}),
    ("sensor_lag:alert", {30.0: "ok", 30.1: "warning", 60.1: "critical"}),
    ("throughput:dashboard", {999.0: "red", 1000.0: "yellow", 10000.0: "green", 40000.0: "blue"}),
    ("success_pct:dashboard", {94.9: "red", 95.0: "yellow", 99.9: "green"}),
    ("errors:dashboard", {0.0: "green", 1.0: "red"}),
    ("idle_in_transaction:summary", {0.0: "healthy", 1.0: "warning", 2.0: "warning", 3.0: "critical"}),
    ("query_seconds:detail", {10.0: "normal", 10.1: "slow", 30.1: "very_slow"}),
])
def test_bands(spark, preset, cases):
    df = spark.createDataFrame([(v,) for v in [*cases, None]], "v double")
    got = {r.v: r.b for r in df.select("v", health.band(F.col("v"), preset).alias("b")).collect()}
    assert got == {**cases, None: None}


def test_blocking_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    activity = [(p, f"q{p % 4}") for p in range(12)]
    locks = [(rnd.choice("xyz"), rnd.randrange(12), rnd.random() < 0.6) for _ in range(80)]
    text = dict(activity)
    want = Counter((text[p], text[r]) for lt, p, ok in locks if not ok
                   for lt2, r, _ in locks if lt2 == lt and r != p)
    got = health.blocking_pairs(spark.createDataFrame(locks, "locktype string, pid int, granted boolean"),
                                spark.createDataFrame(activity, "pid int, query string"), ["locktype"])
    assert {(r.blocked_statement, r.blocking_statement): r.pairs for r in got.collect()} == dict(want)


def test_sessions(spark):
    act = spark.createDataFrame([
        (1, "idle in transaction", "2024-01-01 00:00:00"), (2, "idle in transaction", "2024-01-01 00:09:00"),
        (3, "active", "2024-01-01 00:09:45"), (4, "active", "2024-01-01 00:09:55"), (5, "active", "2024-01-01 00:00:00"),
        (6, None, "2024-01-01 00:00:00")], "pid int, state string, t string") \
        .withColumn("state_change", F.col("t").cast("timestamp"))
    assert rows(health.stale_sessions(act, "2024-01-01 00:10:00").select("pid", "seconds_in_state")) == [(1, 600.0)]
    assert rows(health.long_running(act, "2024-01-01 00:10:00").select("pid", "level")) == [(3, "slow"), (5, "very_slow")]


@pytest.mark.parametrize("chunks,want", [([4, 4, 5], True), ([4, 4, 4], False), ([4, 3, 6], False), ([4], False)])
def test_growing_chunk_count(spark, chunks, want):
    df = spark.createDataFrame([("m", f"2024-01-0{i + 1}", c) for i, c in enumerate(chunks)],
                               "table_name string, d string, chunks int").withColumn("created", F.col("d").cast("timestamp"))
    assert health.growing(df).first().growing is want


def test_alerts(spark):
    frames = {
        "sensor_lag": spark.createDataFrame([("A", 61.0), ("B", 31.0), ("C", 1.0), ("D", None)],
                                            "serial_number string, lag_seconds double"),
        "cache": spark.createDataFrame([("iot", 84.0)], "datname string, cache_hit_ratio double"),
        "dead": spark.createDataFrame([("t", 15.0)], "relname string, dead_pct double"),
        "connections": spark.createDataFrame([("iot", 30), ("iot", 11), ("x", 40)], "datname string, connection_count int"),
    }
    assert rows(health.alerts(frames)) == sorted([
        ("sensor_lag", "critical", "A", 61.0), ("sensor_lag", "warning", "B", 31.0), ("cache_hit", "critical", "iot", 84.0),
        ("dead_pct", "warning", "t", 15.0), ("connections", "critical", "iot", 41.0)], key=str)


def test_never_vacuumed_comes_first(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 5)], "k string, v int")
    assert [r.k for r in health.top(df, "v").collect()] == ["b", "c", "a"]
    assert [r.k for r in health.top(df, "v", 2, "last").collect()] == ["c", "a"]


def test_targets_and_quadrants(spark):
    df = spark.createDataFrame([(1, 0.04, 0.2, 99.95)], "step int, q50 double, q95 double, success_pct double")
    assert rows(health.check_targets(df).select("measure", "met")) == [("q50", True), ("q95", False), ("success_pct", True)]
    io = spark.createDataFrame([(9, 0), (0, 9), (9, 9), (0, 0)], "shared_blks_written int, exec_writes int")
    assert [r.quadrant for r in health.io_quadrant(io, 5, 5).collect()] == [
        "dirtied_not_flushed", "written_elsewhere", "flushing_to_disk", "mostly_idle"]


def test_blocking_pairs_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(health, "TASK_LOCKS", 40)
    rnd = random.Random(6)
    activity = [(p, rnd.choice(["a", "b", None])) for p in range(15)]
    locks = [(rnd.choice("xy"), rnd.choice([1, None]), rnd.choice([7, 8, None]), None, rnd.randrange(16), rnd.random() < 0.6)
             for _ in range(200)]
    want = Counter()
    for *one, p, ok in locks:
        for *other, r, _ in locks:
            if not ok and one == other and r != p:
                want.update((s, t) for q, s in activity if q == p for u, t in activity if u == r)
    got = health.blocking_pairs(
        spark.createDataFrame(locks, "locktype string, database int, relation bigint, transactionid bigint, pid int, granted boolean"),
        spark.createDataFrame(activity, "pid int, query string"))
    # 200 locks are dealt to five tasks, and so is what is left of them by thing.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(share" in plan and ", 5), REPARTITION_BY_NUM" in plan
    assert {(r.blocked_statement, r.blocking_statement): r.pairs for r in got.collect()} == dict(want)
