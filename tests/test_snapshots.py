import re
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import snapshots

AS_OF = "2024-01-01 00:00:15"


def inputs(spark):
    stmts = spark.createDataFrame([(1, 9, 100, "q1"), (1, 8, 100, "q1"), (2, 9, 200, "q2"), (2, 9, 300, "no kcache")],
                                  "userid int, dbid int, queryid bigint, query string")
    for i, c in enumerate(schemas.STATEMENT_COUNTERS):
        stmts = stmts.withColumn(c, (F.col("queryid") + i).cast("double" if c in schemas.DOUBLE_COUNTERS else "bigint"))
    kcache = spark.createDataFrame([(1, 9, 100), (1, 8, 100), (2, 9, 200), (3, 9, 100)],
                                   "userid int, dbid int, queryid bigint")
    for i, c in enumerate(schemas.KCACHE_COUNTERS):
        kcache = kcache.withColumn(c, F.lit(i).cast("double" if c in schemas.DOUBLE_COUNTERS else "bigint"))
    return {
        "statements": stmts, "kcache": kcache,
        "roles": spark.createDataFrame([(1, "r1"), (2, "r2")], "oid int, rolname string"),
        "databases": spark.createDataFrame([(9, "iot"), (8, "postgres")], "oid int, datname string"),
        "activity": spark.createDataFrame([("iot", None), ("iot", "unknown"), ("postgres", "idle")],
                                          "datname string, state string"),
        "sizes": spark.createDataFrame([("m", 1, 2, 3, 6, None), ("detailed", 1, 1, 1, 3, None)],
                                       "hypertable_name string, table_bytes int, index_bytes int, toast_bytes int, "
                                       "total_bytes int, node_name string"),
    }


def test_one_tick(spark):
    out = snapshots.take(inputs(spark), AS_OF, "2024-01-01 00:00:00")
    assert {n: df.count() for n, df in out.items()} == {
        "queries": 2, "snapshots": 1, "statements": 2, "connection_stats": 1, "sizes": 1}
    assert out["statements"].columns == schemas.STATEMENT_COLUMNS
    assert out["snapshots"].columns == ["created", *schemas.SNAPSHOT_COUNTERS, "stats_reset"]
    total = out["snapshots"].first()
    assert total.calls == 100 + 2 + 200 + 2 and total.exec_minflts == 10
    assert rows(out["queries"].select("queryid", "rolname", "query")) == [(100, "r1", "q1"), (200, "r2", "q2")]
    # Sessions without a state and those in the literal state 'unknown' are one group.
    assert rows(out["connection_stats"].select("state", "connection_count")) == [("unknown", 2)]
    assert len({r[0] for df in out.values() if "created" in df.columns for r in df.select("created").collect()}) == 1


def test_no_statements_no_snapshot(spark):
    empty = inputs(spark)
    empty["statements"] = empty["statements"].limit(0)
    out = snapshots.take({k: empty[k] for k in ("statements", "kcache", "roles", "databases")}, AS_OF)
    assert out["snapshots"].count() == 0


def test_ratios(spark):
    from tidewire.functions.ratios import null_safe_pct, safe_pct

    df = spark.createDataFrame([(1, 3), (5, 0), (0, 7), (2, 3), (1, 800)], "x bigint, y bigint")
    got = [(r.a, r.b, r.c) for r in df.select(
        safe_pct(F.col("x"), F.col("y"), 0).alias("a"), safe_pct(F.col("x"), F.col("y"), 100).alias("b"),
        null_safe_pct(F.col("x"), F.col("y")).alias("c")).collect()]
    assert [g[0] for g in got] == [Decimal("33.33"), Decimal("0.00"), Decimal("0.00"), Decimal("66.67"), Decimal("0.13")]
    assert got[1][1] == Decimal("100.00") and got[1][2] is None and abs(got[0][2] - 100 / 3) < 1e-12


def history(spark, data):
    return spark.createDataFrame(data, "t string, k string, c bigint, reset string").select(
        F.col("t").cast("timestamp").alias("created"), "k", "c", F.col("reset").cast("timestamp").alias("stats_reset"))


def test_delta(spark):
    h = history(spark, [
        ("2024-01-01 00:00:00", "a", 10, "2024-01-01"), ("2024-01-01 00:00:15", "a", 15, "2024-01-01"),
        ("2024-01-04 00:00:00", "a", 40, "2024-01-03"), ("2024-01-04 00:00:15", "a", 30, "2024-01-03"),
        ("2024-01-01 00:00:00", "b", 7, "2024-01-01")])
    got = snapshots.delta(h, ["k"], ["c"], "stats_reset")
    assert [r.d_c for r in got.orderBy("k", "created").collect()] == [None, 5, 40, 30, None]
    plain = snapshots.delta(h, ["k"], ["c"])
    assert [r.d_c for r in plain.orderBy("k", "created").collect()] == [None, 5, 25, 30, None]


def test_slowest_takes_the_text(spark):
    d = spark.createDataFrame([(1, "d", "r", 2, 10.0), (1, "d", "r", 2, 30.0), (2, "d", "r", 1, 99.0), (3, "d", "r", 0, 0.0)],
                              "queryid bigint, datname string, rolname string, d_calls bigint, d_total_exec_time double")
    q = spark.createDataFrame([(i, "d", "r", f"q{i}") for i in (1, 2, 3)],
                              "queryid bigint, datname string, rolname string, query string")
    assert rows(snapshots.slowest(d, q, 1).select("query", "mean_exec_time")) == [("q2", 99.0)]
    assert rows(snapshots.slowest(d, q, 9).select("query", "mean_exec_time")) == [("q1", 10.0), ("q2", 99.0)]


def test_append_skips_recorded_keys(spark):
    h = spark.createDataFrame([(1, "a", 5)], "created int, k string, v int")
    new = spark.createDataFrame([(1, "a", 6), (2, "a", 7)], "created int, k string, v int")
    assert rows(snapshots.append_new(h, new, ["created", "k"])) == [(1, "a", 5), (2, "a", 7)]


def test_buffers_are_ordered_by_bytes(spark):
    buffers = spark.createDataFrame([(1, 9)] * 2 + [(2, 9)] * 10 + [(3, 0)] * 3 + [(4, 8)] * 50,
                                    "relfilenode int, reldatabase int")
    classes = spark.createDataFrame([(1, "one"), (2, "two"), (3, "shared"), (4, "other")],
                                    "relfilenode int, relname string")
    dbs = spark.createDataFrame([(9, "iot"), (8, "x")], "oid int, datname string")
    got = [(r.relname, r.buffered_bytes) for r in snapshots.buffered_top(buffers, classes, dbs, k=2).collect()]
    assert got == [("two", 81920), ("shared", 24576)]


def test_statements_of_a_database_are_joined_in_many_tasks(spark):
    statements = [(i % 7, 65 if i % 50 else None, i, float(i)) for i in range(300)]
    base = spark.createDataFrame(statements, "userid int, dbid int, queryid int, calls double").cache()
    kcache = base.select("userid", "dbid", "queryid", *[F.lit(1).alias(c) for c in schemas.KCACHE_COUNTERS])
    roles = spark.createDataFrame([(u, f"r{u}") for u in range(6)], "oid int, rolname string")
    dbs = spark.createDataFrame([(65, "iot"), (66, "other"), (65, "iot")], "oid int, datname string")  # a name may come twice
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c, None) for c in thresholds}
    try:
        for c in thresholds:
            spark.conf.set(c, "-1")
        got = snapshots.statement_base(base, kcache, roles, dbs, None)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(dbid#\d+, cast|hashpartitioning\(dbid#\d+, __share", plan), plan
        assert not re.search(r"hashpartitioning\(dbid#\d+, \d+\)", plan)
        expected = sorted(q for u, d, q, _ in statements if d == 65 and u < 6 for _ in range(2))
        assert sorted(r.queryid for r in got.collect()) == expected and "__share" not in got.columns
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
