"""Schemas and column lists. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- messages -------------------------------------------------------------------------------------
MEASUREMENT_PAYLOAD = "array<struct<SerialNumber:string,Timestamp:timestamp,Value:double>>"
REGISTRATION_PAYLOAD = "struct<SerialNumber:string,SampleFrequency:double>"
COMMAND_PAYLOAD = "struct<SerialNumber:string,Timestamp:timestamp,Command:string,Params:map<string,string>>"
LOG_PAYLOAD = "struct<SerialNumber:string,Timestamp:timestamp,Level:string,Message:string>"

# ---- application tables ---------------------------------------------------------------------------
SENSOR = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("serial_number", T.StringType(), False),
        T.StructField("sample_frequency", T.DoubleType()),
        T.StructField("target_id", T.IntegerType()),
    ]
)
TARGET = T.StructType(
    [T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), False)]
)
MEASUREMENT = T.StructType(
    [
        T.StructField("time", T.TimestampType(), False),
        T.StructField("sensor_id", T.IntegerType(), False),
        T.StructField("measurement", T.DoubleType(), False),
    ]
)
TARGET_LOCATION = T.StructType(
    [
        T.StructField("time", T.TimestampType(), False),
        T.StructField("target_id", T.IntegerType(), False),
        T.StructField(
            "location",
            T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]),
        ),
    ]
)
METRIC_SAMPLE = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("instance", T.StringType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("le", T.DoubleType()),
        T.StructField("value", T.DoubleType(), False),
    ]
)

#: Unique keys of the stored tables (fixed values).
KEYS = {
    "sensor": ["serial_number"],
    "target": ["name"],
    "measurement": ["sensor_id", "time"],
    "snapshots": ["created"],
    "queries": ["queryid", "datname", "rolname"],
    "statements": ["created", "queryid", "rolname", "datname"],
    "table_stats": ["created", "schemaname", "relname"],
    "database_stats": ["created", "datname"],
    "connection_stats": ["created", "datname", "state"],
    "sizes": ["created", "hypertable_name"],
}

# ---- statistics columns (fixed values: the stored column order is a contract) ----------------------
STATEMENT_COUNTERS = (
    "plans total_plan_time calls total_exec_time rows "
    "shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written "
    "local_blks_hit local_blks_read local_blks_dirtied local_blks_written "
    "temp_blks_read temp_blks_written wal_records wal_fpi wal_bytes"
).split()
KCACHE_COUNTERS = (
    "exec_writes exec_reads exec_user_time exec_system_time exec_majflts exec_minflts"
).split()
SNAPSHOT_COUNTERS = (
    "calls total_plan_time total_exec_time rows "
    "exec_writes exec_reads exec_user_time exec_system_time exec_majflts exec_minflts "
    "shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written "
    "local_blks_hit local_blks_read local_blks_dirtied local_blks_written "
    "temp_blks_read temp_blks_written wal_records wal_fpi wal_bytes"
).split()
STATEMENT_COLUMNS = (
    ["created", "queryid", "plans", "total_plan_time", "calls", "total_exec_time", "rows"]
    + KCACHE_COUNTERS
    + STATEMENT_COUNTERS[5:]
    + ["rolname", "datname"]
)
DOUBLE_COUNTERS = {"total_plan_time", "total_exec_time", "exec_user_time", "exec_system_time"}

TABLE_STATS_COLUMNS = (
    "created schemaname relname n_live_tup n_dead_tup dead_tup_ratio "
    "last_vacuum last_autovacuum last_analyze last_autoanalyze "
    "vacuum_count autovacuum_count analyze_count autoanalyze_count "
    "n_tup_ins n_tup_upd n_tup_del n_tup_hot_upd seq_scan seq_tup_read idx_scan idx_tup_fetch"
).split()
DATABASE_STATS_COLUMNS = (
    "created datname numbackends xact_commit xact_rollback blks_read blks_hit cache_hit_ratio "
    "tup_returned tup_fetched tup_inserted tup_updated tup_deleted conflicts temp_files temp_bytes "
    "deadlocks blk_read_time blk_write_time stats_reset"
).split()
SIZE_COLUMNS = "created hypertable_name table_bytes index_bytes toast_bytes total_size node_name".split()
