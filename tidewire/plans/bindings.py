"""Domain views over the benchmark tables, so that every operator runs on whole tables.

Sensors are customers, measurements are events, statement statistics are line items and sessions are
orders. All views are projections and aggregates of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..operators import metrics
from ..operators.decode import JSON_OPTIONS
from ..functions.timing import instant

AS_OF = "2024-01-31 00:00:00"
RANGE = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")
#: A range inside the data, and the sensors some queries name.
INNER_RANGE = ("2024-01-10 12:30:00", "2024-01-12 21:10:00")
CHOSEN = list(range(0, 40))
#: Readings per message, which bounds a message whatever the sensor.
MESSAGE_SIZE = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sensors and measurements ---------------------------------------------------------------------

def sensor(spark, sf) -> DataFrame:
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("serial_number"),
        F.col("c_acctbal").alias("sample_frequency"), F.col("c_nationkey").alias("target_id"))


def valid_sensor(spark, sf) -> DataFrame:
    """Sensors that satisfy the positive-frequency check: the serials known to the ingest."""
    return sensor(spark, sf).where("sample_frequency > 0")


def target(spark, sf) -> DataFrame:
    return load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))


def measurement(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select(
        F.col("ts").alias("time"), F.col("user_id").alias("sensor_id"), F.col("value").alias("measurement"))


def named_events(spark, sf) -> DataFrame:
    """Events with the serial of their sensor."""
    e, s = load(spark, sf, "events"), sensor(spark, sf).select("id", "serial_number")
    return e.join(s, e.user_id == s.id).drop("id")


def readings(spark, sf) -> DataFrame:
    """Decoded readings as they arrive: message id, arrival number, serial, time, value."""
    return named_events(spark, sf).select(
        F.expr(f"event_id div {MESSAGE_SIZE}").alias("batch_id"), F.col("event_id").alias("arrival"),
        "serial_number", F.col("ts").alias("time"), F.col("value").alias("measurement"))


def status_events(spark, sf) -> DataFrame:
    """One processed measurement per event, with the outcome and the replica that handled it."""
    e = load(spark, sf, "events")
    return e.select(
        "ts", "user_id", "value",
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.concat(F.lit("ingester-"), F.col("user_id") % 3).alias("instance"))


def processing(spark, sf) -> DataFrame:
    """Processing seconds of every message and the replica that handled it: a millisecond for each unit of its readings."""
    return readings(spark, sf).groupBy("batch_id").agg((F.sum(F.round(F.col("measurement") * 100).cast("bigint")) / 100_000).alias("seconds")).withColumn(
        "query", F.concat(F.lit("ingester-"), F.col("batch_id") % 3))


# ---- raw messages ---------------------------------------------------------------------------------

def _utc(col: str):
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def raw_measurements(spark, sf) -> DataFrame:
    """JSON array messages of at most MESSAGE_SIZE readings.

    Readings below 1 lose their value on the way, which makes their message malformed.
    """
    reading = F.struct(
        F.col("arrival"), F.col("serial_number").alias("SerialNumber"), _utc("time").alias("Timestamp"),
        F.when(F.col("measurement") >= 1, F.col("measurement")).alias("Value"))
    packed = readings(spark, sf).groupBy("batch_id").agg(F.sort_array(F.collect_list(reading)).alias("r"))
    payload = F.to_json(F.transform("r", lambda r: r.dropFields("arrival")), JSON_OPTIONS)
    return packed.select(
        "batch_id", F.col("batch_id").alias("arrival"),
        F.concat_ws(".", F.lit("sensor"), F.col("r")[0]["SerialNumber"], F.lit("measurements")).alias("topic"),
        payload.alias("value"))


def raw_registrations(spark, sf) -> DataFrame:
    return sensor(spark, sf).select(
        F.col("id").alias("arrival"),
        F.to_json(F.struct(F.col("serial_number").alias("SerialNumber"),
                           F.col("sample_frequency").alias("SampleFrequency"))).alias("value"))


def command_params():
    """Parameters of a command event: none for small values, text for large ones, else the number."""
    k = F.get_json_object("props", "$.k")
    number = F.when(F.col("value") >= 200, F.lit("fast")).otherwise(k)
    return F.when((F.col("event_type") == "purchase") & (F.col("value") >= 5),
                  F.create_map(F.lit("sampleFrequency"), number)).otherwise(
        F.create_map().cast("map<string,string>"))


def raw_commands(spark, sf) -> DataFrame:
    # Command word per event type.
    word = F.create_map(*[F.lit(x) for x in (
        "click", "sleep", "view", "awake", "purchase", "changeSampleFrequency", "signup", "login",
        "error", "reboot")])
    return named_events(spark, sf).select(
        F.col("event_id").alias("arrival"),
        F.to_json(F.struct(
            F.col("serial_number").alias("SerialNumber"), _utc("ts").alias("Timestamp"),
            word[F.col("event_type")].alias("Command"), command_params().alias("Params"))).alias("value"))


def raw_logs(spark, sf) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING") \
        .otherwise("INFO")
    return named_events(spark, sf).select(
        F.col("event_id").alias("arrival"),
        F.to_json(F.struct(
            F.col("serial_number").alias("SerialNumber"), _utc("ts").alias("Timestamp"),
            level.alias("Level"), F.col("props").alias("Message"))).alias("value"))


def topics(spark, sf) -> DataFrame:
    """Topics of all shapes the sensors use, and one with a word too many."""
    # Topic tails.
    tails = ["logs", "measurements", "registry.created", "commands.sleep", "b.logs"]
    names = load(spark, sf, "customer").select("c_name")
    return names.select(F.explode(F.transform(
        F.array(*[F.lit(t) for t in tails]),
        lambda t: F.concat_ws(".", F.lit("sensor"), F.col("c_name"), t))).alias("topic"))


# ---- metric samples -------------------------------------------------------------------------------

SCRAPE, RESTART, VALUE_BOUNDS = "1 hour", "1 week", metrics.exponential_bounds(1.0, 2.0, 10)


def processed_samples(spark, sf) -> DataFrame:
    """Counter of processed measurements per (status, instance, sensor), scraped hourly; the replicas
    restart every week."""
    return metrics.counter_samples(status_events(spark, sf), "ts", ["status", "instance", "user_id"], SCRAPE,
                                   instant(AS_OF), epoch=RESTART, by=["user_id"])


def published_samples(spark, sf) -> DataFrame:
    """Counter of received messages per instance and protocol, scraped hourly."""
    received = status_events(spark, sf).withColumn("protocol", F.lit("stream"))
    return metrics.counter_samples(received, "ts", ["protocol", "instance"], SCRAPE, instant(AS_OF))


def value_buckets(spark, sf, labels=("instance",), step=SCRAPE) -> DataFrame:
    """Histogram samples of the event value."""
    return metrics.histogram_samples(status_events(spark, sf), "ts", "value", VALUE_BOUNDS, list(labels), step,
                                     instant(AS_OF))


# ---- statistics sources ---------------------------------------------------------------------------

#: Counter -> aggregate over line items, in SQL both engines read alike (fixed values).
STATEMENT_EXPRS = {
    "plans": "count(CASE WHEN l_linestatus = 'F' THEN 1 END)",
    "total_plan_time": "sum(l_tax * 1000)",
    "calls": "count(*)",
    "total_exec_time": "sum(l_extendedprice)",
    "rows": "cast(sum(cast(l_quantity AS bigint)) AS bigint)",
    **{c: f"cast(sum(cast(l_quantity AS bigint) * {i + 2}) AS bigint)"
       for i, c in enumerate(schemas.STATEMENT_COUNTERS[5:-1])},
    "wal_bytes": "cast(sum(cast(floor(l_extendedprice) AS bigint)) AS bigint)",
}
KCACHE_EXPRS = {
    "exec_writes": "cast(sum(cast(floor(l_extendedprice) AS bigint)) AS bigint)",
    "exec_reads": "cast(sum(cast(l_quantity AS bigint) * 512) AS bigint)",
    "exec_user_time": "sum(l_discount)",
    "exec_system_time": "sum(l_tax)",
    "exec_majflts": "count(CASE WHEN l_linestatus = 'O' THEN 1 END)",
    "exec_minflts": "count(*)",
}


def _statement_keys(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("userid"), F.ascii("l_returnflag").alias("dbid"),
        F.col("l_partkey").alias("queryid"), "*")


def _grouped(spark, sf, exprs) -> DataFrame:
    return _statement_keys(spark, sf).groupBy("userid", "dbid", "queryid").agg(
        *[F.expr(e).alias(c) for c, e in exprs.items()])


def statements(spark, sf) -> DataFrame:
    return _grouped(spark, sf, STATEMENT_EXPRS).withColumn(
        "query", F.concat(F.lit("select part "), F.col("queryid")))


def kcache(spark, sf) -> DataFrame:
    return _grouped(spark, sf, KCACHE_EXPRS)


def roles(spark, sf) -> DataFrame:
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_name").alias("rolname"))


def databases(spark, sf) -> DataFrame:
    flags = load(spark, sf, "lineitem").select("l_returnflag").distinct()
    return flags.select(F.ascii("l_returnflag").alias("oid"),
                        F.when(F.col("l_returnflag") == "R", "iot")
                        .otherwise(F.concat(F.lit("db_"), "l_returnflag")).alias("datname"))


def _start_of(unit: str, col: str):
    return F.trunc(F.col(col).cast("date"), unit).cast("timestamp_ntz")


def statement_history(spark, sf) -> DataFrame:
    """Cumulative monthly counters per (supplier, database); the statistics are reset every January."""
    month = _start_of("month", "l_shipdate")
    reset = _start_of("year", "created")
    monthly = load(spark, sf, "lineitem").groupBy(
        month.alias("created"), F.col("l_suppkey").alias("queryid"), F.col("l_returnflag").alias("datname")
    ).agg(F.count("*").alias("calls"), F.sum("l_extendedprice").alias("total_exec_time"),
          F.sum(F.col("l_quantity").cast("bigint")).alias("rows"))
    since_reset = W.partitionBy("queryid", "datname", reset).orderBy("created")
    return monthly.select(
        "created", "queryid", "datname", F.concat(F.lit("role_"), "datname").alias("rolname"),
        F.sum("calls").over(since_reset).alias("calls"),
        F.sum("total_exec_time").over(since_reset).alias("total_exec_time"),
        F.sum("rows").over(since_reset).alias("rows"), reset.alias("stats_reset"))


def history_queries(spark, sf) -> DataFrame:
    s = load(spark, sf, "supplier")
    flags = load(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    return flags.join(s, flags.l_suppkey == s.s_suppkey).select(
        F.col("s_suppkey").alias("queryid"), F.col("l_returnflag").alias("datname"),
        F.concat(F.lit("role_"), "l_returnflag").alias("rolname"),
        F.concat(F.lit("select * from "), "s_name").alias("query"))


def user_tables(spark, sf) -> DataFrame:
    """Table statistics of one 'table' per part; some have no live rows or were never vacuumed."""
    p = load(spark, sf, "part")
    day = F.timestamp_add("DAY", F.col("p_size").cast("bigint"), instant("2024-01-01 00:00:00"))
    vacuumed = F.when(F.col("p_size") > 10, day)
    n = F.col("p_size").cast("bigint")
    return p.select(
        F.col("p_partkey").alias("relid"),
        F.when(F.col("p_type") == "ECONOMY", "public").when(F.col("p_type") == "SMALL", "_timescaledb_internal")
        .otherwise("pg_catalog").alias("schemaname"),
        F.concat(F.when(F.col("p_size") % 2 == 0, "sensor_measurement_").otherwise("other_"),
                 F.col("p_partkey")).alias("relname"),
        F.when(F.col("p_size") < 5, 0).otherwise(n * 7).cast("bigint").alias("n_live_tup"),
        (F.col("p_partkey") % 50).alias("n_dead_tup"),
        vacuumed.alias("last_vacuum"), vacuumed.alias("last_autovacuum"), day.alias("last_analyze"),
        day.alias("last_autoanalyze"),
        *[(n * i).alias(c) for i, c in enumerate(schemas.TABLE_STATS_COLUMNS[10:], start=1)])


def database_counters(spark, sf) -> DataFrame:
    """Database statistics of one 'database' per order priority, and one that was never read."""
    o = load(spark, sf, "orders")
    total = F.sum(F.col("o_totalprice").cast("bigint"))
    n = F.count("*")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "iot").otherwise(F.col("o_orderpriority"))
    read = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("bigint")).otherwise(F.lit(0))
    miss = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).otherwise(F.lit(0))
    return o.groupBy(name.alias("datname")).agg(
        F.count_if(F.col("o_orderstatus") == "O").cast("int").alias("numbackends"),
        F.count_if(F.col("o_orderstatus") == "F").alias("xact_commit"),
        F.count_if(F.col("o_orderstatus") == "P").alias("xact_rollback"),
        F.sum(miss).alias("blks_read"), F.sum(read).alias("blks_hit"),
        *[(n * i).alias(c) for i, c in enumerate(schemas.DATABASE_STATS_COLUMNS[8:15], start=1)],
        total.alias("temp_bytes"), F.lit(0).cast("bigint").alias("deadlocks"),
        F.round(F.sum("o_totalprice"), 2).alias("blk_read_time"), n.cast("double").alias("blk_write_time"),
        F.min("o_orderdate").alias("stats_reset"))


def activity(spark, sf) -> DataFrame:
    """Sessions: one per order. Some have no state, some the literal state 'unknown'."""
    o = load(spark, sf, "orders")
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("pid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "iot").otherwise(F.col("o_orderpriority")).alias("datname"),
        F.when((status == "O") & (price < 100000), F.lit(None)).when((status == "O") & (price < 200000), "unknown")
        .when(status == "O", "active").when(status == "F", "idle").otherwise("idle in transaction").alias("state"),
        F.col("o_orderdate").alias("state_change"),
        F.concat(F.lit("statement of customer "), "o_custkey").alias("query"))


def locks(spark, sf) -> DataFrame:
    """Locks: one per line item on its order, held or awaited by the session of its supplier. All are of one type."""
    return load(spark, sf, "lineitem").select(
        F.lit("relation").alias("locktype"), F.lit(1).alias("database"), F.col("l_orderkey").alias("relation"),
        F.lit(None).cast("bigint").alias("transactionid"), F.col("l_suppkey").alias("pid"),
        (F.col("l_linestatus") == "F").alias("granted"))


def supplier_sessions(spark, sf) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pid"),
        F.when(F.col("s_nationkey") > 0, F.concat(F.lit("restock nation "), "s_nationkey")).alias("query"))


def buffers(spark, sf) -> DataFrame:
    """Cached pages: one per line item. The file is the part, the database its return flag, 0 for N."""
    return load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("relfilenode"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(F.ascii("l_returnflag")).alias("reldatabase"))


def classes(spark, sf) -> DataFrame:
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("relfilenode"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("relname"))


def table_sizes(spark, sf) -> DataFrame:
    """Sizes of one 'table' per supplier, and of the size history itself."""
    li = load(spark, sf, "lineitem")
    name = F.when(F.col("l_suppkey") == 0, "detailed").otherwise(F.concat(F.lit("table_"), "l_suppkey"))
    size = F.col("l_quantity").cast("bigint")
    return li.groupBy(name.alias("hypertable_name")).agg(
        F.sum(size * 8192).alias("table_bytes"), F.sum(size * 1024).alias("index_bytes"),
        F.count("*").alias("toast_bytes"), F.sum(size * 9216 + 1).alias("total_bytes"),
    ).withColumn("node_name", F.lit(None).cast("string"))


def size_history(spark, sf) -> DataFrame:
    """Total size of every supplier's 'table' at the end of each month."""
    li = load(spark, sf, "lineitem")
    month = _start_of("month", "l_shipdate")
    monthly = li.groupBy(month.alias("created"), F.concat(F.lit("table_"), "l_suppkey").alias("hypertable_name")) \
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("added"))
    order = W.partitionBy("hypertable_name").orderBy("created")
    return monthly.select("created", "hypertable_name", (F.sum("added").over(order) * 8192).alias("total_size"))
