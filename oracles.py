"""SQL counterparts of the registered queries, written independently for a single-node SQL engine."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"

# ---- columns of the statistics tables (fixed values: the stored column order is a contract) ----------
STATEMENT_COLUMNS = (
    "created queryid plans total_plan_time calls total_exec_time rows exec_writes exec_reads exec_user_time "
    "exec_system_time exec_majflts exec_minflts shared_blks_hit shared_blks_read shared_blks_dirtied "
    "shared_blks_written local_blks_hit local_blks_read local_blks_dirtied local_blks_written temp_blks_read "
    "temp_blks_written wal_records wal_fpi wal_bytes rolname datname"
).split()
SNAPSHOT_COUNTERS = (
    "calls total_plan_time total_exec_time rows exec_writes exec_reads exec_user_time exec_system_time exec_majflts "
    "exec_minflts shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written local_blks_hit "
    "local_blks_read local_blks_dirtied local_blks_written temp_blks_read temp_blks_written wal_records wal_fpi "
    "wal_bytes"
).split()
DOUBLE_COUNTERS = ["total_plan_time", "total_exec_time", "exec_user_time", "exec_system_time"]
TABLE_STATS_COLUMNS = (
    "created schemaname relname n_live_tup n_dead_tup dead_tup_ratio last_vacuum last_autovacuum last_analyze "
    "last_autoanalyze vacuum_count autovacuum_count analyze_count autoanalyze_count n_tup_ins n_tup_upd n_tup_del "
    "n_tup_hot_upd seq_scan seq_tup_read idx_scan idx_tup_fetch"
).split()
DATABASE_STATS_COLUMNS = (
    "created datname numbackends xact_commit xact_rollback blks_read blks_hit cache_hit_ratio tup_returned "
    "tup_fetched tup_inserted tup_updated tup_deleted conflicts temp_files temp_bytes deadlocks blk_read_time "
    "blk_write_time stats_reset"
).split()
#: Counters that are the n-th multiple of the quantity, n from 2.
BLOCK_COUNTERS = (
    "shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written local_blks_hit local_blks_read "
    "local_blks_dirtied local_blks_written temp_blks_read temp_blks_written wal_records wal_fpi"
).split()

#: What stands in for the counters of a statement (supplier, flag, part), in SQL.
STATEMENTS = {
    "plans": "count(CASE WHEN l_linestatus = 'F' THEN 1 END)",
    "total_plan_time": "sum(l_tax * 1000)",
    "calls": "count(*)",
    "total_exec_time": "sum(l_extendedprice)",
    "rows": "cast(sum(cast(l_quantity AS bigint)) AS bigint)",
    **{c: f"cast(sum(cast(l_quantity AS bigint) * {n}) AS bigint)" for n, c in enumerate(BLOCK_COUNTERS, start=2)},
    "wal_bytes": "cast(sum(cast(floor(l_extendedprice) AS bigint)) AS bigint)",
}
KCACHE = {
    "exec_writes": "cast(sum(cast(floor(l_extendedprice) AS bigint)) AS bigint)",
    "exec_reads": "cast(sum(cast(l_quantity AS bigint) * 512) AS bigint)",
    "exec_user_time": "sum(l_discount)",
    "exec_system_time": "sum(l_tax)",
    "exec_majflts": "count(CASE WHEN l_linestatus = 'O' THEN 1 END)",
    "exec_minflts": "count(*)",
}

# ---- shared views as CTE text ----------------------------------------------------------------------

SENSOR = """sensor AS (SELECT c_custkey AS id, c_name AS serial_number, c_acctbal AS sample_frequency,
  c_nationkey AS target_id FROM customer)"""
MEASUREMENT = "m AS (SELECT ts AS time, user_id AS sensor_id, value AS measurement FROM events)"
NAMED = "named AS (SELECT e.*, c_name AS serial_number FROM events e JOIN customer ON user_id = c_custkey)"
GAPFILL = f"""
means AS (SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, sensor_id, avg(measurement) AS v FROM m
  WHERE time >= {START} AND time < {AS_OF} GROUP BY 1, 2),
spine AS (SELECT s.sensor_id, t.bucket FROM (SELECT DISTINCT sensor_id FROM means) s,
  (SELECT unnest(generate_series({START}, {AS_OF} - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS bucket) t),
filled AS (SELECT spine.bucket AS time, round(v, 9) AS measurement, serial_number
  FROM spine LEFT JOIN means USING (sensor_id, bucket) JOIN sensor ON sensor.id = spine.sensor_id)"""

STATUS = """st AS (SELECT ts, user_id, value, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  'ingester-' || (user_id % 3) AS instance, 'stream' AS protocol,
  CASE WHEN time_bucket(INTERVAL '1 hour', ts) = ts THEN ts
       ELSE time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR END AS tick,
  CASE WHEN time_bucket(INTERVAL '1 day', ts) = ts THEN ts
       ELSE time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY END AS day_tick FROM events)"""
PROCESSED = STATUS + f""",
inc AS (SELECT status, instance, user_id, tick,
  time_bucket(INTERVAL '1 week', tick - INTERVAL 1 MICROSECOND) AS epoch, count(*) AS n FROM st GROUP BY ALL),
run AS (SELECT *, sum(n) OVER w AS v, lead(tick) OVER w AS nx FROM inc
  WINDOW w AS (PARTITION BY status, instance, user_id, epoch ORDER BY tick)),
samples AS (SELECT status, instance, user_id, v::DOUBLE AS value, unnest(generate_series(tick,
  coalesce(nx - INTERVAL 1 MICROSECOND, least(epoch + INTERVAL 7 DAY, {AS_OF})), INTERVAL 1 HOUR)) AS ts FROM run)"""
PUBLISHED = f"""
pinc AS (SELECT protocol, instance, tick, count(*) AS n FROM st GROUP BY ALL),
prun AS (SELECT *, sum(n) OVER w AS v, lead(tick) OVER w AS nx FROM pinc
  WINDOW w AS (PARTITION BY protocol, instance ORDER BY tick)),
psamples AS (SELECT protocol, instance, v::DOUBLE AS value, unnest(generate_series(tick,
  coalesce(nx - INTERVAL 1 MICROSECOND, {AS_OF}), INTERVAL 1 HOUR)) AS ts FROM prun)"""


def buckets(label: str, tick: str, step: str) -> str:
    """Histogram samples of the value per label."""
    return f"""
bounds AS (SELECT (2.0 ** i)::DOUBLE AS le FROM generate_series(0, 9) t(i) UNION ALL SELECT 'infinity'::DOUBLE),
ticks AS (SELECT DISTINCT {label}, {tick} AS tick FROM st),
hinc AS (SELECT ticks.{label}, ticks.tick, bounds.le, count(st.value) AS n FROM ticks CROSS JOIN bounds
  LEFT JOIN st ON st.{label} = ticks.{label} AND st.{tick} = ticks.tick AND st.value <= bounds.le GROUP BY ALL),
hrun AS (SELECT *, sum(n) OVER w AS v, lead(tick) OVER w AS nx FROM hinc
  WINDOW w AS (PARTITION BY {label}, le ORDER BY tick)),
hsamples AS (SELECT {label}, le, v::DOUBLE AS value, unnest(generate_series(tick,
  coalesce(nx - INTERVAL 1 MICROSECOND, {AS_OF}), INTERVAL {step})) AS ts FROM hrun)"""


def rate(out: str, samples: str, series: str, range_: str, step: str, where: str = "true") -> str:
    """Increase per second of the samples in (step - range, step], as a join of steps and samples."""
    seconds = f"(epoch(INTERVAL {range_}))"
    return f"""
{out}_d AS (SELECT {series}, ts, value, CASE WHEN value < lag(value) OVER w THEN value
  ELSE value - lag(value) OVER w END AS d FROM {samples} WHERE {where}
  WINDOW w AS (PARTITION BY {series} ORDER BY ts)),
{out}_t AS (SELECT unnest(generate_series({START}, {AS_OF} + INTERVAL {range_}, INTERVAL {step})) AS step),
{out} AS (SELECT {series}, step, (sum(coalesce(d, 0)) - coalesce(arg_min(coalesce(d, 0), ts), 0)) / {seconds} AS rate,
    sum(coalesce(d, 0)) - arg_min(coalesce(d, 0), ts) AS gained, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
    arg_min(value, ts) AS first_value
  FROM {out}_t JOIN {out}_d ON ts > step - INTERVAL {range_} AND ts <= step
  GROUP BY {series}, step HAVING count(*) >= 2)"""


def irate(out: str, samples: str, series: str, range_: str, step: str) -> str:
    return f"""
{out}_t AS (SELECT unnest(generate_series({START}, {AS_OF} + INTERVAL {range_}, INTERVAL {step})) AS step),
{out}_2 AS (SELECT {series}, step, ts, value, row_number() OVER (PARTITION BY {series}, step ORDER BY ts DESC) AS rn
  FROM {out}_t JOIN {samples} ON ts > step - INTERVAL {range_} AND ts <= step),
{out} AS (SELECT {series}, a.step, (CASE WHEN a.value < b.value THEN a.value ELSE a.value - b.value END)
    / epoch(a.ts - b.ts) AS rate
  FROM {out}_2 a JOIN {out}_2 b USING ({series}, step) WHERE a.rn = 1 AND b.rn = 2)"""


def quantile(out: str, source: str, by: str, qs: dict[str, float]) -> str:
    pieces = ", ".join(
        f"""CASE WHEN max(total) > 0 THEN arg_min(CASE WHEN le = 'infinity'::DOUBLE THEN lo
        ELSE lo + (le - lo) * (total * {q} - below) / (c - below) END, le) FILTER (WHERE c >= total * {q} * (1 - 1e-9::DOUBLE)) END AS {name}"""
        for name, q in qs.items())
    return f"""
{out}_w AS (SELECT {by}, le, rate AS c, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(rate) OVER w, 0) AS below,
  last_value(rate) OVER (PARTITION BY {by} ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
  FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY le)),
{out} AS (SELECT {by}, {pieces} FROM {out}_w GROUP BY {by})"""


QS = {"q50": 0.5, "q95": 0.95, "q99": 0.99}
KNOWN = "known AS (SELECT c_custkey AS id, c_name AS serial_number, c_acctbal AS sample_frequency FROM customer WHERE c_acctbal > 0)"
READINGS = """readings AS (SELECT event_id // 8 AS batch_id, event_id AS arrival, c_name AS serial_number, ts AS time,
  value AS measurement FROM events JOIN customer ON user_id = c_custkey)"""
COMMANDS = """commands AS (SELECT event_id AS arrival, c_name AS serial_number, ts AS time,
  CASE event_type WHEN 'click' THEN 'sleep' WHEN 'view' THEN 'awake' WHEN 'purchase' THEN 'changeSampleFrequency'
    WHEN 'signup' THEN 'login' ELSE 'reboot' END AS command,
  CASE WHEN event_type = 'purchase' AND value >= 5 THEN
    CASE WHEN value >= 200 THEN 'fast' ELSE props->>'$.k' END END AS frequency_param, c_acctbal
  FROM events JOIN customer ON user_id = c_custkey)"""
LOG_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"


def _grouped(exprs: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    return f"SELECT l_suppkey AS userid, ascii(l_returnflag) AS dbid, l_partkey AS queryid, {cols} FROM lineitem GROUP BY 1, 2, 3"


BASE = f"""s AS ({_grouped(STATEMENTS)}), k AS ({_grouped(KCACHE)}),
dbs AS (SELECT DISTINCT ascii(l_returnflag) AS oid,
  CASE WHEN l_returnflag = 'R' THEN 'iot' ELSE 'db_' || l_returnflag END AS datname FROM lineitem),
base AS (SELECT s.*, k.* EXCLUDE (userid, dbid, queryid), 'select part ' || s.queryid AS query, s_name AS rolname, datname
  FROM s JOIN k ON s.userid = k.userid AND s.dbid = k.dbid AND s.queryid = k.queryid
  JOIN supplier ON s.userid = s_suppkey JOIN dbs ON s.dbid = dbs.oid)"""


def _round4(cols) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" if c in DOUBLE_COUNTERS else c for c in cols)


TABLES = """t AS (SELECT p_partkey AS relid,
  CASE p_type WHEN 'ECONOMY' THEN 'public' WHEN 'SMALL' THEN '_timescaledb_internal' ELSE 'pg_catalog' END AS schemaname,
  CASE WHEN p_size % 2 = 0 THEN 'sensor_measurement_' ELSE 'other_' END || p_partkey AS relname,
  (CASE WHEN p_size < 5 THEN 0 ELSE p_size * 7 END)::BIGINT AS n_live_tup, (p_partkey % 50)::BIGINT AS n_dead_tup,
  CASE WHEN p_size > 10 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) END AS last_vacuum,
  last_vacuum AS last_autovacuum, TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS last_analyze,
  last_analyze AS last_autoanalyze, """ + ", ".join(
    f"(p_size * {i})::BIGINT AS {c}" for i, c in enumerate(TABLE_STATS_COLUMNS[10:], start=1)) + " FROM part)"
SCHEMA_FILTER = "schemaname IN ('public', '_timescaledb_internal')"
DEAD_RATIO = "(CASE WHEN n_live_tup > 0 THEN round((n_dead_tup * 100)::DECIMAL(18,6) / n_live_tup, 2) ELSE 0 END)::DOUBLE"
DB_NAME = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'iot' ELSE o_orderpriority END"
DATABASES = f"""db AS (SELECT {DB_NAME} AS datname,
  (count(*) FILTER (WHERE o_orderstatus = 'O'))::INTEGER AS numbackends,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS xact_commit, count(*) FILTER (WHERE o_orderstatus = 'P') AS xact_rollback,
  sum(CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey ELSE 0 END)::BIGINT AS blks_read,
  sum(CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice)::BIGINT ELSE 0 END)::BIGINT AS blks_hit, """ + ", ".join(
    f"count(*) * {i} AS {c}" for i, c in enumerate(DATABASE_STATS_COLUMNS[8:15], start=1)) + """,
  sum(floor(o_totalprice)::BIGINT)::BIGINT AS temp_bytes, 0::BIGINT AS deadlocks,
  round(sum(o_totalprice), 2) AS blk_read_time, count(*)::DOUBLE AS blk_write_time, min(o_orderdate) AS stats_reset
  FROM orders GROUP BY 1),
hit AS (SELECT *, (CASE WHEN blks_hit + blks_read > 0 THEN round(100.0 * blks_hit / (blks_hit + blks_read), 2)
  ELSE 100 END)::DOUBLE AS cache_hit_ratio FROM db)"""
ACTIVITY = f"""act AS (SELECT o_orderkey AS pid, {DB_NAME} AS datname, CASE
  WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN NULL WHEN o_orderstatus = 'O' AND o_totalprice < 200000 THEN 'unknown'
  WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'idle' ELSE 'idle in transaction' END AS state,
  o_orderdate AS state_change, 'statement of customer ' || o_custkey AS query FROM orders)"""
CONNECTIONS = f"""conn AS (SELECT {AS_OF} AS created, datname, coalesce(state, 'unknown') AS state,
  count(*)::INTEGER AS connection_count FROM act GROUP BY 1, 2, 3)"""
SIZES = """sizes AS (SELECT CASE WHEN l_suppkey = 0 THEN 'detailed' ELSE 'table_' || l_suppkey END AS hypertable_name,
  sum(l_quantity::BIGINT * 8192)::BIGINT AS table_bytes, sum(l_quantity::BIGINT * 1024)::BIGINT AS index_bytes,
  count(*) AS toast_bytes, sum(l_quantity::BIGINT * 9216 + 1)::BIGINT AS total_bytes FROM lineitem GROUP BY 1)"""
HISTORY = """monthly AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS created, l_suppkey AS queryid, l_returnflag AS datname,
  count(*) AS c, sum(l_extendedprice) AS x, sum(l_quantity::BIGINT) AS r FROM lineitem GROUP BY 1, 2, 3),
hist AS (SELECT created, queryid, datname, 'role_' || datname AS rolname, (sum(c) OVER w)::BIGINT AS calls,
  sum(x) OVER w AS total_exec_time, (sum(r) OVER w)::BIGINT AS rows, date_trunc('year', created)::TIMESTAMP AS stats_reset
  FROM monthly WINDOW w AS (PARTITION BY queryid, datname, date_trunc('year', created) ORDER BY created)),
prev AS (SELECT *, lag(calls) OVER w AS pc, lag(total_exec_time) OVER w AS px, lag(rows) OVER w AS pr,
  lag(stats_reset) OVER w AS ps FROM hist WINDOW w AS (PARTITION BY queryid, datname, rolname ORDER BY created)),
deltas AS (SELECT created, queryid, datname, rolname,
  CASE WHEN pc IS NULL THEN NULL WHEN ps <> stats_reset OR calls < pc THEN calls ELSE calls - pc END AS d_calls,
  CASE WHEN px IS NULL THEN NULL WHEN ps <> stats_reset OR total_exec_time < px THEN total_exec_time
    ELSE total_exec_time - px END AS d_total_exec_time,
  CASE WHEN pr IS NULL THEN NULL WHEN ps <> stats_reset OR rows < pr THEN rows ELSE rows - pr END AS d_rows FROM prev)"""
CHUNKED = "ch AS (SELECT ts AS time, user_id AS sensor_id, value AS measurement, time_bucket(INTERVAL '5 minutes', ts) AS chunk_start, (user_id % 4)::INTEGER AS hash_part FROM events)"
CATALOG = f"""cat AS (SELECT chunk_start, hash_part, count(*) AS row_count, min(sensor_id) AS min_sensor_id,
  max(sensor_id) AS max_sensor_id, min(time) AS min_time, max(time) AS max_time,
  chunk_start + INTERVAL 5 MINUTE AS chunk_end, epoch({AS_OF} - (chunk_start + INTERVAL 5 MINUTE)) / 60.0 AS age
  FROM ch GROUP BY chunk_start, hash_part)"""
DAYS = """days AS (SELECT ts AS time, user_id AS sensor_id, time_bucket(INTERVAL '1 day', ts) AS chunk_start, (user_id % 4)::INTEGER AS hash_part,
  event_id % 10 = 0 AND user_id % 4 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' AS late FROM events)"""
TEN = "3, 4, 17, 40, 41, 77, 90, 91, 120, 149"
BATCH = """batch AS (SELECT ts AS time, user_id AS sensor_id, value AS measurement, event_id AS arrival FROM events
  UNION ALL SELECT ts, user_id, value + 1000, event_id + 1000000000000 FROM events),
stored AS (SELECT ts AS time, user_id AS sensor_id, -value AS measurement FROM events
  WHERE ts < TIMESTAMP '2024-01-08 00:00:00')"""


def case(col: str, *bands: tuple[str, str]) -> str:
    body = " ".join(f"WHEN {col} {cond} THEN '{name}'" for name, cond in bands[:-1])
    return f"CASE WHEN {col} IS NULL THEN NULL {body} ELSE '{bands[-1][0]}' END"


LAG_SUMMARY = (("healthy", "< 5"), ("warning", "<= 30"), ("critical", ""))
LAG_DETAIL = (("healthy", "< 5"), ("warning", "< 15"), ("critical", "<= 60"), ("offline", ""))
LAG_ALERT = (("ok", "<= 30"), ("warning", "<= 60"), ("critical", ""))
HIT_SUMMARY = (("critical", "< 95"), ("warning", "<= 99"), ("healthy", ""))
HIT_DETAIL = (("poor", "< 90"), ("fair", "< 95"), ("good", "< 99"), ("excellent", ""))
HIT_ALERT = (("critical", "< 85"), ("warning", "< 95"), ("ok", ""))
DEAD_SUMMARY = (("healthy", "< 5"), ("warning", "<= 10"), ("critical", ""))
DEAD_DETAIL = (("excellent", "< 5"), ("good", "< 10"), ("warning", "<= 20"), ("critical", ""))
DEAD_ALERT = (("ok", "<= 10"), ("warning", "<= 20"), ("critical", ""))

MALFORMED = "malformed AS (SELECT batch_id FROM readings GROUP BY 1 HAVING min(measurement) < 1)"

TOOK = """took AS (SELECT batch_id, 'ingester-' || (batch_id % 3) AS query, sum(round(measurement * 100)::BIGINT)::DOUBLE / 100000 AS seconds
  FROM readings GROUP BY 1, 2)"""
SECONDS_BOUNDS = """bounds AS (SELECT 0.001::DOUBLE * (2.0 ** i)::DOUBLE AS le FROM generate_series(0, 14) t(i) UNION ALL SELECT 'infinity'::DOUBLE)"""
STREAMED = f"""WITH {READINGS}, {MALFORMED}, {KNOWN},
      r AS (SELECT readings.*, id FROM readings LEFT JOIN known USING (serial_number)
        WHERE batch_id NOT IN (SELECT batch_id FROM malformed))
      SELECT time, id AS sensor_id, measurement FROM r WHERE batch_id NOT IN (SELECT batch_id FROM r WHERE id IS NULL)"""

STATE = f"""eff AS (SELECT *, CASE command WHEN 'sleep' THEN true WHEN 'awake' THEN false END AS sets_asleep,
  CASE WHEN command = 'changeSampleFrequency' THEN try_cast(frequency_param AS DOUBLE) END AS sets_hz FROM commands),
tl AS (SELECT *, coalesce(last_value(sets_asleep IGNORE NULLS) OVER w, false) AS was_asleep,
  coalesce(last_value(sets_hz IGNORE NULLS) OVER w, c_acctbal) AS was_hz FROM eff
  WINDOW w AS (PARTITION BY serial_number ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

LOGS = f"""logs AS (SELECT event_id AS arrival, c_name AS serial_number, ts AS time, {LOG_LEVEL} AS level, props AS message
  FROM events JOIN customer ON user_id = c_custkey),
lines AS (SELECT format('time="{{}}" logger="{{}}" level="{{}}" message="{{}}"',
  regexp_replace(strftime(time, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z', serial_number, level, message) AS line FROM logs)"""
# What went in must come out, quotes in the message included.
PARSED_LOGS = f"WITH {LOGS} SELECT time, serial_number AS logger, level, message FROM logs"

COMMAND_LOGS = f"""WITH {COMMANDS}, {STATE}, hz AS (SELECT *, regexp_replace(was_hz::VARCHAR, '\\.0$', '') AS was_text,
        regexp_replace(sets_hz::VARCHAR, '\\.0$', '') AS new_text FROM tl),
      one AS (SELECT serial_number, time, arrival, 0 AS seq,
        CASE WHEN command IN ('sleep', 'awake') OR (command = 'changeSampleFrequency' AND sets_hz IS NOT NULL) THEN 'INFO' ELSE 'WARNING' END AS level,
        CASE WHEN command = 'sleep' AND was_asleep THEN 'sensor is already in a sleep state' WHEN command = 'sleep' THEN 'sensor is set to sleep'
          WHEN command = 'awake' AND was_asleep THEN 'sensor is awake from sleep at ' || was_text || ' [Hz]'
          WHEN command = 'awake' THEN 'sensor is already in an awake state'
          WHEN command = 'changeSampleFrequency' AND sets_hz IS NULL THEN 'SampleFrequency is not a number. Skipping...'
          WHEN command = 'changeSampleFrequency' THEN 'Sample frequency changed to ' || new_text || ' [Hz]'
          ELSE 'not a valid command' END AS message FROM hz)
      SELECT * FROM one UNION ALL SELECT serial_number, time, arrival, 1, 'INFO',
        'changes of sample frequency applied, but sensor is currently in a sleep state' FROM hz
        WHERE command = 'changeSampleFrequency' AND sets_hz IS NOT NULL AND was_asleep"""

ORACLES: dict[str, str] = {
    # ---- series ----
    "series_gapfill": f"WITH {SENSOR}, {MEASUREMENT}, {GAPFILL} SELECT * FROM filled",
    "series_raw": f"WITH {SENSOR}, {MEASUREMENT} SELECT time, measurement, serial_number FROM m JOIN sensor ON sensor_id = id",
    "series_raw_range": f"""WITH {SENSOR}, {MEASUREMENT} SELECT time, measurement, serial_number FROM m JOIN sensor ON sensor_id = id
      WHERE sample_frequency > 0 AND time >= {START} AND time < {AS_OF}""",
    "series_list_range": f"""WITH {SENSOR}, {MEASUREMENT} SELECT time, measurement, serial_number FROM m JOIN sensor ON sensor_id = id
      WHERE id BETWEEN 0 AND 39 AND time >= TIMESTAMP '2024-01-10 12:30:00' AND time < TIMESTAMP '2024-01-12 21:10:00'""",
    "bucket_weekly": f"""WITH {MEASUREMENT} SELECT time_bucket(INTERVAL '1 week', time) AS bucket, sensor_id,
      round(avg(measurement), 9) AS measurement, count(*) AS n FROM m GROUP BY 1, 2""",
    "panel_reducers": f"""WITH {SENSOR}, {MEASUREMENT}, {GAPFILL} SELECT serial_number,
      arg_max(measurement, time) FILTER (WHERE measurement IS NOT NULL) AS last_not_null,
      arg_max(CASE WHEN measurement IS NOT NULL THEN measurement END, time) FILTER (WHERE time = {AS_OF} - INTERVAL 1 HOUR) AS last_value,
      round(avg(measurement), 9) AS mean_value, max(measurement) AS max_value, round(sum(measurement), 6) AS sum_value,
      round(quantile_cont(measurement, 0.99), 6) AS p99_value FROM filled GROUP BY 1""",
    "latest_per_key": f"WITH {MEASUREMENT} SELECT sensor_id, max(time) AS time, arg_max(measurement, time) AS measurement FROM m GROUP BY 1",
    "latest_stored": f"""WITH {MEASUREMENT} SELECT max(time) AS time, sensor_id, arg_max(measurement, time) AS measurement FROM m
      WHERE sensor_id IN (SELECT c_custkey FROM customer) GROUP BY sensor_id""",
    "panel_percentiles": f"""WITH {MEASUREMENT} SELECT round(quantile_cont(measurement, 0.5), 6) AS p50, round(quantile_cont(measurement, 0.95), 6) AS p95,
      round(quantile_cont(measurement, 0.99), 6) AS p99, max(measurement) AS max FROM m""",
    "sensor_counts": f"""WITH {SENSOR}, {MEASUREMENT} SELECT serial_number, count(sensor_id) AS row_count,
      round(any_value(sample_frequency) * 1800.0, 6) AS expected_rows FROM sensor LEFT JOIN m ON id = sensor_id GROUP BY serial_number""",
    "insert_rate": f"""WITH {SENSOR}, {MEASUREMENT} SELECT serial_number,
      round(count(sensor_id)::DOUBLE / epoch({AS_OF} - {START}), 9) AS rows_per_second,
      any_value(sample_frequency) AS expected_per_second FROM sensor
      LEFT JOIN m ON id = sensor_id AND time >= {START} AND time < {AS_OF} GROUP BY serial_number""",
    "sensor_lag": f"""WITH {SENSOR}, {MEASUREMENT}, l AS (SELECT serial_number, max(time) AS last_time,
      epoch({AS_OF} - max(time)) AS lag FROM sensor LEFT JOIN m ON id = sensor_id GROUP BY 1)
      SELECT serial_number, last_time, round(lag, 6) AS lag_seconds, {case('lag', *LAG_SUMMARY)} AS band_summary,
      {case('lag', *LAG_DETAIL)} AS band_detail, {case('lag', *LAG_ALERT)} AS band_alert FROM l""",
    # ---- registry ----
    "sensor_lookup": f"""WITH {NAMED}, {KNOWN} SELECT n.serial_number, id, sample_frequency, id IS NOT NULL AS found
      FROM (SELECT DISTINCT serial_number FROM named) n LEFT JOIN known USING (serial_number)""",
    "sensor_list": "SELECT c_name AS serial_number FROM customer",
    "target_list": "SELECT n_name AS name FROM nation",
    "table_scan": f"WITH {SENSOR} SELECT * FROM sensor",
    "semi_exists": f"WITH {SENSOR} SELECT * FROM sensor WHERE EXISTS (SELECT 1 FROM events WHERE user_id = sensor.id)",
    "registry_new": """SELECT ((SELECT max(c_custkey) FROM customer WHERE c_acctbal > 0)
      + row_number() OVER (ORDER BY md5(c_name), c_name))::BIGINT AS id, c_name AS serial_number, c_acctbal AS sample_frequency
      FROM customer WHERE NOT c_acctbal > 0""",
    "target_new": """SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY md5(name), name))::INTEGER AS id, name
      FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) WHERE name NOT IN (SELECT n_name FROM nation)""",
    "cascade_delete": """WITH gone AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 0),
      sensors AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT id FROM gone))
      SELECT 'target' AS table_name, count(*) AS row_count FROM nation WHERE n_nationkey NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'sensor', count(*) FROM sensors
      UNION ALL SELECT 'measurement', count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM sensors)""",
    "cascade_queries": f"WITH {HISTORY} SELECT created, queryid, datname, rolname, calls FROM hist WHERE rolname <> 'role_A'",
    # ---- text rules ----
    "serial_validity": r"""WITH texts AS (
      SELECT unnest([c_name, substr(c_name, 1, 8), substr(c_name, 12, 7), 'AAD-' || substr(c_name, 15, 4),
        'ñ½-' || substr(c_name, 16, 3), substr(c_name, 1, 3) || chr(10)]) AS t FROM customer
      UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation
      UNION SELECT substr(s_name, 1, 4) FROM supplier)
      SELECT DISTINCT t AS serial_text, regexp_matches(t, '\p{L}') AND strlen(t) <= 8
        AND regexp_matches(t, '\A[\p{L}\p{N}-]*\z') AS valid FROM texts""",
    "constraint_split": """SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN '' ELSE 'frequency_not_positive' END AS violations,
      c_acctbal > 0 AS accepted FROM customer""",
    "topic_routes": r"""WITH t AS (SELECT 'sensor.' || c_name || '.' || tail AS topic FROM customer,
      (SELECT unnest(['logs', 'measurements', 'registry.created', 'commands.sleep', 'b.logs']) AS tail))
      SELECT topic, concat_ws(',',
        CASE WHEN regexp_matches(topic, '^sensor\.[^.]+\.commands(\..+)?$') THEN 'commands' END,
        CASE WHEN regexp_matches(topic, '^sensor\.[^.]+\.logs(\..+)?$') THEN 'logs' END,
        CASE WHEN regexp_matches(topic, '^sensor\.[^.]+\.measurements(\..+)?$') THEN 'measurements' END,
        CASE WHEN regexp_matches(topic, '^sensor\.[^.]+\.registry(\..+)?$') THEN 'registry' END) AS routes FROM t""",
    "command_validity": f"""WITH {COMMANDS} SELECT command,
      command IN ('login', 'logout', 'sleep', 'awake', 'changeSampleFrequency', 'delete') AS known,
      command IN ('sleep', 'awake', 'changeSampleFrequency') AS accepted, count(*) AS n FROM commands GROUP BY 1, 2, 3""",
    # ---- messages ----
    "decode_measurements": f"""WITH {READINGS}, {MALFORMED} SELECT batch_id,
      (row_number() OVER (PARTITION BY batch_id ORDER BY arrival) - 1)::INTEGER AS pos, serial_number, time, measurement
      FROM readings WHERE batch_id NOT IN (SELECT batch_id FROM malformed)""",
    "malformed_messages": f"WITH {READINGS}, {MALFORMED} SELECT batch_id FROM malformed",
    "decode_registry": "SELECT c_custkey AS arrival, c_name AS serial_number, c_acctbal AS sample_frequency FROM customer",
    "decode_logs": f"WITH {LOGS} SELECT * FROM logs",
    "decode_commands": f"WITH {COMMANDS} SELECT arrival, serial_number, time, command, frequency_param FROM commands",
    "unnest_arrays": f"WITH {READINGS} SELECT batch_id, time, serial_number, measurement FROM readings",
    "logfmt_roundtrip": PARSED_LOGS,
    "log_lines": f"WITH {LOGS} SELECT line FROM lines",
    "pack_payload": f"""WITH {NAMED} SELECT serial_number, date_trunc('second', ts)::TIMESTAMP AS period_start, count(*)::INTEGER AS n,
      round(sum(value), 6) AS total, min(ts) AS first_time FROM named GROUP BY 1, 2""",
    # ---- ingest ----
    "ingest_strict": f"""WITH {READINGS}, {KNOWN}, r AS (SELECT readings.*, id FROM readings LEFT JOIN known USING (serial_number))
      SELECT time, id AS sensor_id, measurement, batch_id FROM r
      WHERE batch_id NOT IN (SELECT batch_id FROM r WHERE id IS NULL)""",
    "ingest_strict_rejected": f"""WITH {READINGS}, {KNOWN}, r AS (SELECT readings.*, id FROM readings LEFT JOIN known USING (serial_number))
      SELECT batch_id, serial_number, time, measurement FROM r WHERE batch_id IN (SELECT batch_id FROM r WHERE id IS NULL)""",
    "ingest_quarantine": f"""WITH {READINGS}, {KNOWN} SELECT time, serial_number, id AS sensor_id,
      CASE WHEN id IS NULL THEN 'quarantined' ELSE 'written' END AS outcome FROM readings LEFT JOIN known USING (serial_number)""",
    "ingest_dedup": f"""WITH {BATCH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, time ORDER BY arrival) AS rn FROM batch)
      SELECT time, sensor_id, measurement FROM stored UNION ALL SELECT time, sensor_id, measurement FROM ranked
      WHERE rn = 1 AND (sensor_id, time) NOT IN (SELECT (sensor_id, time) FROM stored)""",
    "append_modes": f"""WITH {BATCH}, held AS (SELECT DISTINCT sensor_id, time, true AS held FROM stored)
      SELECT sensor_id, time, count(*) AS in_batch, coalesce(held, false) AS in_target FROM batch LEFT JOIN held USING (sensor_id, time)
      GROUP BY sensor_id, time, held HAVING count(*) > 1 OR held""",
    "late_flag": f"""WITH {MEASUREMENT} SELECT time, sensor_id, measurement, {AS_OF} - time > INTERVAL 7 DAY AS late FROM m""",
    "batch_stats": f"""WITH {READINGS} SELECT batch_id, serial_number, count(*) AS n, min(time) AS oldest_time,
      round(epoch({AS_OF} - min(time)), 6) AS latency_seconds FROM readings GROUP BY 1, 2""",
    # ---- metrics ----
    "counter_totals": f"WITH {STATUS} SELECT status, user_id, count(*) AS value FROM st GROUP BY 1, 2",
    "counter_running": f"""WITH {PROCESSED}, l AS (SELECT status, instance, user_id, arg_max(value, ts) AS v FROM samples GROUP BY 1, 2, 3)
      SELECT user_id, sum(v) AS value FROM l WHERE status = 'success' GROUP BY 1""",
    "counter_by_event": f"""WITH {STATUS} SELECT status, user_id, ts,
      (count(*) OVER (PARTITION BY status, user_id ORDER BY ts))::BIGINT AS value FROM st""",
    "metric_samples": f"WITH {PROCESSED} SELECT status, instance, user_id, ts, value FROM samples",
    "histogram_build": f"""WITH {STATUS}, bounds AS (SELECT (2.0 ** i)::DOUBLE AS le FROM generate_series(0, 9) t(i)
        UNION ALL SELECT 'infinity'::DOUBLE), totals AS (SELECT user_id, count(*) AS c, round(sum(value), 6) AS s FROM st GROUP BY 1)
      SELECT user_id, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0 ELSE le END AS le,
        (SELECT count(*) FROM st WHERE st.user_id = totals.user_id AND value <= le) AS bucket_count,
        c AS total_count, s AS total_sum FROM totals CROSS JOIN bounds""",
    "batch_size_histogram": f"""WITH {READINGS}, n AS (SELECT batch_id, count(*) AS n FROM readings GROUP BY 1),
      bounds AS (SELECT (2.0 ** i)::DOUBLE AS le FROM generate_series(0, 19) t(i) UNION ALL SELECT 'infinity'::DOUBLE)
      SELECT CASE WHEN le = 'infinity'::DOUBLE THEN -1.0 ELSE le END AS le, count(*) FILTER (WHERE n <= le) AS bucket_count,
        count(*) AS messages, sum(n)::BIGINT AS readings FROM n CROSS JOIN bounds GROUP BY bounds.le""",
    "latency_histogram": f"""WITH {READINGS}, done AS (SELECT batch_id, max(time) AS completed FROM readings GROUP BY 1),
      l AS (SELECT serial_number, batch_id, round(epoch(any_value(completed) - min(time)), 6) AS v
        FROM readings JOIN done USING (batch_id) GROUP BY 1, 2),
      bounds AS (SELECT 0.01::DOUBLE * (2.0 ** i)::DOUBLE AS le FROM generate_series(0, 11) t(i) UNION ALL SELECT 'infinity'::DOUBLE)
      SELECT serial_number, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0 ELSE round(le, 6) END AS le,
        count(*) FILTER (WHERE v <= le) AS bucket_count, count(*) AS observations, round(sum(v), 6) AS total_seconds
      FROM l CROSS JOIN bounds GROUP BY serial_number, bounds.le""",
    "processing_histogram": f"""WITH {READINGS}, {TOOK}, {SECONDS_BOUNDS}
      SELECT query, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0 ELSE round(le, 6) END AS le, count(*) FILTER (WHERE seconds <= le) AS bucket_count,
        count(*) AS messages, round(sum(seconds), 6) AS total_seconds FROM took CROSS JOIN bounds GROUP BY query, bounds.le""",
    "processing_quantiles": f"""WITH {READINGS}, {TOOK}, {SECONDS_BOUNDS},
      h AS (SELECT query, le, (count(*) FILTER (WHERE seconds <= le))::DOUBLE AS rate FROM took CROSS JOIN bounds GROUP BY query, bounds.le),
      {quantile('q', 'h', 'query', QS)} SELECT query, round(q50, 6) AS q50, round(q95, 6) AS q95, round(q99, 6) AS q99 FROM q""",
    "counter_rate": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'6 hours'", "'2 hours'", "status = 'success'")}
      SELECT step, user_id, round(sum(rate), 9) AS rate FROM r GROUP BY 1, 2""",
    "counter_rate_total": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'6 hours'", "'2 hours'", "status = 'success'")}
      SELECT step, round(sum(rate), 9) AS rate FROM r GROUP BY 1""",
    "counter_rate_extrapolated": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'6 hours'", "'2 hours'")},
      x AS (SELECT *, epoch(last_ts - first_ts) AS sampled, sampled / (n - 1) AS gap,
        epoch(first_ts - (step - INTERVAL 6 HOUR)) AS a0, epoch(step - last_ts) AS b0 FROM r),
      y AS (SELECT *, CASE WHEN a0 >= gap * 1.1 THEN gap / 2 ELSE a0 END AS a1, CASE WHEN b0 >= gap * 1.1 THEN gap / 2 ELSE b0 END AS b1 FROM x),
      z AS (SELECT *, CASE WHEN gained > 0 AND sampled * first_value / gained < a1 THEN sampled * first_value / gained ELSE a1 END AS a2 FROM y)
      SELECT step, status, round(sum(gained * (sampled + a2 + b1) / sampled / 21600.0::DOUBLE), 9) AS rate FROM z GROUP BY 1, 2""",
    "instant_rate": f"""WITH {STATUS}, {PUBLISHED}, {irate('r', 'psamples', 'protocol, instance', "'3 hours'", "'1 hour'")}
      SELECT step, round(sum(rate), 9) AS rate FROM r GROUP BY 1""",
    "histogram_quantile": f"""WITH {STATUS}, {buckets('instance', 'tick', "'1 hour'")},
      {rate('r', 'hsamples', 'instance, le', "'6 hours'", "'1 hour'")},
      per_le AS (SELECT step, le, sum(rate) AS rate FROM r GROUP BY 1, 2), {quantile('q', 'per_le', 'step', QS)}
      SELECT step, round(q50, 6) AS q50, round(q95, 6) AS q95, round(q99, 6) AS q99 FROM q""",
    "histogram_quantile_by_sensor": f"""WITH {STATUS}, {buckets('user_id', 'day_tick', "'1 day'")},
      {rate('r', 'hsamples', 'user_id, le', "'7 days'", "'1 day'")},
      {quantile('q', 'r', 'step, user_id', {'q95': 0.95})} SELECT step, user_id, round(q95, 6) AS q95 FROM q""",
    "success_rate": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'12 hours'", "'3 hours'")},
      p AS (SELECT step, round(100.0::DOUBLE * sum(rate) FILTER (WHERE status = 'success') / nullif(sum(rate), 0), 6) AS success_pct
        FROM r GROUP BY 1)
      SELECT step, success_pct, {case('success_pct', ('red', '< 95'), ('yellow', '< 99.9'), ('green', ''))} AS band FROM p""",
    "success_rate_extrapolated": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'12 hours'", "'3 hours'")},
      x AS (SELECT *, epoch(last_ts - first_ts) AS sampled, sampled / (n - 1) AS gap,
        epoch(first_ts - (step - INTERVAL 12 HOUR)) AS a0, epoch(step - last_ts) AS b0 FROM r),
      y AS (SELECT *, CASE WHEN a0 >= gap * 1.1 THEN gap / 2 ELSE a0 END AS a1, CASE WHEN b0 >= gap * 1.1 THEN gap / 2 ELSE b0 END AS b1 FROM x),
      z AS (SELECT *, gained * (sampled + CASE WHEN gained > 0 AND sampled * first_value / gained < a1 THEN sampled * first_value / gained
        ELSE a1 END + b1) / sampled AS v FROM y)
      SELECT step, round(100.0::DOUBLE * sum(v) FILTER (WHERE status = 'success') / nullif(sum(v), 0), 6) AS success_pct FROM z GROUP BY 1""",
    "publish_vs_process": f"""WITH {PROCESSED}, {PUBLISHED}, {irate('i', 'psamples', 'protocol, instance', "'3 hours'", "'1 hour'")},
      {rate('r', 'samples', 'status, instance, user_id', "'2 hours'", "'1 hour'", "status = 'success'")},
      p AS (SELECT step, sum(rate) AS published FROM i GROUP BY 1), q AS (SELECT step, sum(rate) AS processed FROM r GROUP BY 1)
      SELECT step, round(published, 9) AS published, round(processed, 9) AS processed,
        round(coalesce(published, 0) - coalesce(processed, 0), 9) AS backlog FROM p FULL JOIN q USING (step)""",
    "panel_overlay": f"""WITH {PROCESSED}, {rate('r', 'samples', 'status, instance, user_id', "'6 hours'", "'2 hours'")}
      SELECT status AS series, step, round(sum(rate), 9) AS rate FROM r GROUP BY 1, 2""",
    "latency_targets": f"""WITH {PROCESSED}, {buckets('instance', 'tick', "'1 hour'")},
      {rate('h', 'hsamples', 'instance, le', "'6 hours'", "'3 hours'")},
      per_le AS (SELECT step, le, sum(rate) AS rate FROM h GROUP BY 1, 2), {quantile('q', 'per_le', 'step', QS)},
      {rate('r', 'samples', 'status, instance, user_id', "'12 hours'", "'3 hours'")},
      p AS (SELECT step, 100.0::DOUBLE * sum(rate) FILTER (WHERE status = 'success') / nullif(sum(rate), 0) AS success_pct FROM r GROUP BY 1),
      all_ AS (SELECT * FROM q JOIN p USING (step)),
      long AS (SELECT step, 'q50' AS measure, q50 AS value, 0.05::DOUBLE AS target, q50 < 0.05 AS met FROM all_
        UNION ALL SELECT step, 'q95', q95, 0.1, q95 < 0.1 FROM all_ UNION ALL SELECT step, 'q99', q99, 0.2, q99 < 0.2 FROM all_
        UNION ALL SELECT step, 'success_pct', success_pct, 99.9, success_pct > 99.9 FROM all_)
      SELECT step, measure, round(value, 6) AS value, target, met FROM long""",
    # ---- snapshots ----
    "statement_base": f"WITH {BASE} SELECT {AS_OF} AS created, {_round4(STATEMENT_COLUMNS[1:])} FROM base",
    "snapshot_totals": f"""WITH {BASE} SELECT {AS_OF} AS created, {', '.join(
        f'round(sum({c}), 4) AS {c}' if c in DOUBLE_COUNTERS else f'sum({c})::BIGINT AS {c}' for c in SNAPSHOT_COUNTERS)},
      {START} AS stats_reset FROM base WHERE datname = 'iot' HAVING count(*) > 0""",
    "query_dim": f"WITH {BASE} SELECT DISTINCT queryid, datname, rolname, query FROM base WHERE datname <> 'db_A'",
    "table_stats_snapshot": f"""WITH {TABLES} SELECT {AS_OF} AS created, {DEAD_RATIO} AS dead_tup_ratio,
      {', '.join(c for c in TABLE_STATS_COLUMNS[1:] if c != 'dead_tup_ratio')} FROM t WHERE {SCHEMA_FILTER}""",
    "db_stats_snapshot": f"WITH {DATABASES} SELECT {AS_OF} AS created, * FROM hit",
    "connection_stats": f"WITH {ACTIVITY}, {CONNECTIONS} SELECT * FROM conn",
    "cache_and_connections": f"""WITH {ACTIVITY}, {CONNECTIONS}, {DATABASES} SELECT datname, state, connection_count, cache_hit_ratio,
      {case('cache_hit_ratio', *HIT_DETAIL)} AS band FROM conn JOIN hit USING (datname) WHERE datname = 'iot'""",
    "foreign_table_stats": f"""WITH {TABLES} SELECT schemaname || '.' || relname AS table_key, n_live_tup, n_dead_tup, last_autovacuum
      FROM t WHERE {SCHEMA_FILTER}""",
    "size_snapshot": f"""WITH {SIZES} SELECT {AS_OF} AS created, hypertable_name, table_bytes, index_bytes, toast_bytes,
      total_bytes AS total_size, NULL::VARCHAR AS node_name FROM sizes WHERE hypertable_name <> 'detailed'""",
    "history_append": f"""WITH {ACTIVITY}, {CONNECTIONS} SELECT created, datname, state,
      CASE WHEN state = 'idle' THEN -1 ELSE connection_count END::INTEGER AS connection_count FROM conn""",
    "snapshot_take": f"""WITH {BASE}, {TABLES}, {DATABASES}, {ACTIVITY}, {CONNECTIONS}, {SIZES},
      iot AS (SELECT * FROM base WHERE datname = 'iot')
      SELECT 'queries' AS table_name, count(DISTINCT (queryid, datname, rolname)) AS row_count FROM iot
      UNION ALL SELECT 'snapshots', 1 UNION ALL SELECT 'statements', count(*) FROM iot
      UNION ALL SELECT 'table_stats', count(*) FROM t WHERE {SCHEMA_FILTER}
      UNION ALL SELECT 'database_stats', count(*) FROM hit WHERE datname = 'iot'
      UNION ALL SELECT 'connection_stats', count(*) FROM conn WHERE datname = 'iot'
      UNION ALL SELECT 'sizes', count(*) FROM sizes WHERE hypertable_name <> 'detailed'""",
    "snapshot_delta": f"""WITH {HISTORY} SELECT created, queryid, datname, rolname, d_calls,
      round(d_total_exec_time, 4) AS d_total_exec_time, d_rows FROM deltas""",
    "slowest_queries": f"""WITH {HISTORY}, sums AS (SELECT queryid, datname, rolname, sum(d_calls)::BIGINT AS calls,
        sum(d_total_exec_time) AS x FROM deltas GROUP BY 1, 2, 3)
      SELECT queryid, datname, rolname, calls, round(x, 4) AS total_exec_time, round(x / calls, 4) AS mean_exec_time,
        'select * from ' || s_name AS query FROM sums JOIN supplier ON queryid = s_suppkey WHERE calls > 0
      ORDER BY x / calls DESC, queryid, datname, rolname LIMIT 10""",
    "size_growth": """WITH monthly AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS created, 'table_' || l_suppkey AS hypertable_name,
        sum(l_quantity::BIGINT) AS added FROM lineitem GROUP BY 1, 2),
      h AS (SELECT created, hypertable_name, (sum(added) OVER (PARTITION BY hypertable_name ORDER BY created) * 8192)::BIGINT AS total_size FROM monthly)
      SELECT *, total_size - lag(total_size) OVER (PARTITION BY hypertable_name ORDER BY created) AS growth FROM h""",
    "dead_rows": f"""WITH {TABLES}, d AS (SELECT relname, n_dead_tup AS dead_tuples, n_live_tup AS live_tuples,
        round(n_dead_tup::DOUBLE / nullif(n_live_tup, 0) * 100, 6) AS dead_pct FROM t WHERE relname LIKE '%sensor_measurement%')
      SELECT *, {case('dead_pct', *DEAD_DETAIL)} AS band FROM d""",
    "dead_rows_history": f"""WITH {TABLES}, h AS (SELECT *, TIMESTAMP '2024-01-12 21:10:00' AS created, n_dead_tup AS d FROM t
        UNION ALL SELECT *, {AS_OF}, n_dead_tup + 1 FROM t)
      SELECT relname, created, d AS dead_tuples, n_live_tup AS live_tuples, round(d::DOUBLE / nullif(n_live_tup, 0) * 100, 6) AS dead_pct
      FROM h WHERE {SCHEMA_FILTER}""",
    "dead_rows_latest": f"""WITH {TABLES} SELECT relname, {AS_OF} AS created, n_dead_tup + 1 AS dead_tuples, n_live_tup AS live_tuples,
        round((n_dead_tup + 1)::DOUBLE / nullif(n_live_tup, 0) * 100, 6) AS dead_pct FROM t WHERE {SCHEMA_FILTER}""",
    "autovacuum_list": f"""WITH {TABLES} SELECT schemaname, relname, last_autovacuum, last_autoanalyze, autovacuum_count, autoanalyze_count
      FROM t WHERE relname LIKE '%sensor_measurement%'""",
    "buffer_top": f"""WITH pages AS (SELECT l_partkey, CASE WHEN l_returnflag = 'N' THEN 0 ELSE ascii(l_returnflag) END AS reldatabase FROM lineitem)
      SELECT p_brand || ' ' || p_type || ' ' || p_name AS relname, count(*) * 8192 AS buffered_bytes,
        CASE WHEN count(*) * 8192 < 10240 THEN (count(*) * 8192) || ' bytes'
          WHEN count(*) * 16 < 20479 THEN (count(*) * 16 + 1) // 2 || ' kB'
          WHEN count(*) * 16 // 1024 < 20479 THEN (count(*) * 16 // 1024 + 1) // 2 || ' MB'
          ELSE (count(*) * 16 // 1048576 + 1) // 2 || ' GB' END AS buffered FROM pages JOIN part ON l_partkey = p_partkey
      WHERE reldatabase IN (0, ascii('R')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    # ---- lifecycle ----
    "chunk_assignment": f"WITH {CHUNKED} SELECT * FROM ch",
    "chunk_catalog": f"WITH {CHUNKED}, {CATALOG} SELECT * EXCLUDE (age), round(age, 6) AS age_minutes, age >= 15 AS compacted FROM cat",
    "chunk_distribution": f"""WITH {CHUNKED}, {CATALOG} SELECT chunk_start, count(*) AS chunks,
      count(*) FILTER (WHERE age >= 15) AS compacted_chunks, sum(row_count)::BIGINT AS row_count, max(row_count) AS largest_chunk
      FROM cat GROUP BY 1""",
    "newest_chunks": f"""WITH {CHUNKED}, {CATALOG} SELECT chunk_start, hash_part, chunk_end, age >= 15 AS compacted,
      round(age, 6) AS age_minutes FROM cat ORDER BY chunk_start DESC, hash_part LIMIT 20""",
    "retention": f"""WITH {MEASUREMENT} SELECT * FROM m
      WHERE time_bucket(INTERVAL '1 day', time) + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
    "skip_scan": f"""WITH {DAYS} SELECT chunk_start, hash_part, count(*) AS row_count,
      NOT (bool_or(sensor_id IN ({TEN})) AND chunk_start >= TIMESTAMP '2024-01-10' AND chunk_start < TIMESTAMP '2024-01-20') AS skipped
      FROM days GROUP BY 1, 2""",
    "pruned_scan": f"""WITH {MEASUREMENT} SELECT * FROM m WHERE sensor_id IN ({TEN})
      AND time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-20 00:00:00'""",
    "sensor_range_scan": f"WITH {MEASUREMENT} SELECT * FROM m WHERE sensor_id BETWEEN 20 AND 23",
    "catalog_listing": f"""WITH {DAYS}, c AS (SELECT chunk_start, hash_part, count(*) AS row_count, min(sensor_id) AS min_sensor_id,
        max(sensor_id) AS max_sensor_id, min(time) AS min_time, max(time) AS max_time, count(DISTINCT sensor_id) AS n_sensors,
        chunk_start + INTERVAL 2 DAY <= TIMESTAMP '2024-01-16 06:00:00' AND NOT bool_or(late) AS compacted FROM days GROUP BY 1, 2)
      SELECT *, CASE WHEN compacted THEN true END AS measured FROM c""",
    "retention_stored": f"""WITH {MEASUREMENT} SELECT * FROM m
      WHERE time_bucket(INTERVAL '1 day', time) + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
    "delete_stored": f"""WITH {MEASUREMENT} SELECT * FROM m
      WHERE sensor_id NOT IN (SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal > 0, false))""",
    "ingest_stored": f"""WITH {BATCH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, time ORDER BY arrival) AS rn FROM batch)
      SELECT time, sensor_id, measurement FROM stored UNION ALL SELECT time, sensor_id, measurement FROM ranked
      WHERE rn = 1 AND (sensor_id, time) NOT IN (SELECT (sensor_id, time) FROM stored)
      UNION ALL SELECT TIMESTAMP '2023-01-05 08:00:00', unnest([-1, -2])::BIGINT, 1.0::DOUBLE""",
    "compaction": f"WITH {CHUNKED} SELECT * FROM ch",
    "compression_ratio": f"""WITH {CHUNKED}, sized AS (SELECT chunk_start, hash_part, count(*) * 20 AS b0,
        count(DISTINCT sensor_id) * 4 + count(*) * 16 AS b1 FROM ch GROUP BY 1, 2)
      SELECT 'sensor_measurement' AS table_name, count(*) AS chunks, sum(b0)::BIGINT AS bytes_before, sum(b1)::BIGINT AS bytes_after,
        round(sum(b0)::DOUBLE / sum(b1)::DOUBLE, 6) AS ratio FROM sized WHERE chunk_start + INTERVAL 20 MINUTE <= {AS_OF}""",
    # ---- health ----
    "like_filter": f"WITH {TABLES} SELECT relid, relname FROM t WHERE relname LIKE '%sensor_measurement%'",
    "stale_sessions": f"""WITH {ACTIVITY} SELECT pid, datname, query, round(epoch(TIMESTAMP '2002-01-01 00:00:00' - state_change), 6) AS seconds_in_state
      FROM act WHERE state = 'idle in transaction' AND TIMESTAMP '2002-01-01 00:00:00' - state_change > INTERVAL 1 MINUTE""",
    "long_running": f"""WITH {ACTIVITY}, a AS (SELECT pid, round(epoch(TIMESTAMP '2002-01-01 00:00:00' - state_change), 6) AS seconds
        FROM act WHERE state = 'active')
      SELECT pid, seconds, CASE WHEN seconds <= 30 THEN 'slow' ELSE 'very_slow' END AS level FROM a WHERE seconds > 10""",
    "null_safe_ratio": f"WITH {TABLES} SELECT relid, round(n_dead_tup::DOUBLE / nullif(n_live_tup, 0) * 100, 6) AS dead_pct FROM t",
    "blocking_pairs": """WITH act AS (SELECT s_suppkey AS pid,
          CASE WHEN s_nationkey > 0 THEN 'restock nation ' || s_nationkey END AS query FROM supplier),
        l AS (SELECT l_orderkey AS relation, l_suppkey AS pid, l_linestatus = 'F' AS granted FROM lineitem)
      SELECT ba.query AS blocked_statement, ga.query AS blocking_statement, count(*) AS pairs
      FROM l b JOIN act ba ON ba.pid = b.pid JOIN l g ON g.relation = b.relation AND g.pid <> b.pid JOIN act ga ON ga.pid = g.pid
      WHERE NOT b.granted GROUP BY 1, 2""",
    "health_bands": f"""WITH {TABLES}, {DATABASES}, d AS (SELECT relname AS key, {DEAD_RATIO} AS v FROM t WHERE {SCHEMA_FILTER})
      SELECT key, 'dead_pct' AS kind, v AS value, {case('v', *DEAD_SUMMARY)} AS summary, {case('v', *DEAD_DETAIL)} AS detail,
        {case('v', *DEAD_ALERT)} AS alert FROM d
      UNION ALL SELECT datname, 'cache_hit', cache_hit_ratio, {case('cache_hit_ratio', *HIT_SUMMARY)},
        {case('cache_hit_ratio', *HIT_DETAIL)}, {case('cache_hit_ratio', *HIT_ALERT)} FROM hit""",
    "gauge_bands": f"""WITH {STATUS}, d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(*)::DOUBLE AS throughput,
        (count(*) FILTER (WHERE status = 'error'))::DOUBLE AS errors FROM st GROUP BY 1)
      SELECT *, CASE WHEN throughput < 1000 THEN 'red' WHEN throughput < 10000 THEN 'yellow' WHEN throughput < 40000 THEN 'green'
        ELSE 'blue' END AS throughput_band, CASE WHEN errors < 1 THEN 'green' ELSE 'red' END AS errors_band FROM d""",
    "alerts": f"""WITH {SENSOR}, {MEASUREMENT}, {TABLES}, {DATABASES}, {ACTIVITY}, {CONNECTIONS},
      lag AS (SELECT serial_number AS key, epoch({AS_OF} - max(time)) AS v FROM sensor JOIN m ON id = sensor_id GROUP BY 1),
      dead AS (SELECT relname AS key, {DEAD_RATIO} AS v FROM t WHERE {SCHEMA_FILTER}),
      used AS (SELECT datname AS key, sum(connection_count)::DOUBLE AS v FROM conn GROUP BY 1),
      days AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(DISTINCT user_id % 4) AS n FROM events GROUP BY 1),
      steps AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS p FROM days),
      all_ AS (SELECT 'sensor_lag' AS rule, {case('v', *LAG_ALERT)} AS severity, key, v FROM lag
        UNION ALL SELECT 'cache_hit', {case('cache_hit_ratio', *HIT_ALERT)}, datname, cache_hit_ratio FROM hit
        UNION ALL SELECT 'dead_pct', {case('v', *DEAD_ALERT)}, key, v FROM dead
        UNION ALL SELECT 'connections', CASE WHEN v > 40 THEN 'critical' END, key, v FROM used
        UNION ALL SELECT 'chunk_count', CASE WHEN bool_and(p IS NULL OR n >= p) AND arg_max(n, day) > arg_min(n, day)
          THEN 'warning' END, 'sensor_measurement', arg_max(n, day)::DOUBLE FROM steps)
      SELECT rule, severity, key, round(v, 6) AS value FROM all_ WHERE severity IN ('critical', 'warning')""",
    "io_quadrant": f"""WITH {BASE}, q AS (SELECT shared_blks_written AS w, CASE
        WHEN shared_blks_written > 300 AND NOT exec_writes > 50000 THEN 'dirtied_not_flushed'
        WHEN NOT shared_blks_written > 300 AND exec_writes > 50000 THEN 'written_elsewhere'
        WHEN shared_blks_written > 300 THEN 'flushing_to_disk' ELSE 'mostly_idle' END AS quadrant FROM base)
      SELECT quadrant, count(*) AS n, sum(w)::BIGINT AS blks_written FROM q GROUP BY 1""",
    # ---- commands ----
    "command_state": f"""WITH {COMMANDS}, {STATE} SELECT serial_number,
      coalesce(arg_max(sets_asleep, arrival) FILTER (WHERE sets_asleep IS NOT NULL), false) AS asleep,
      coalesce(arg_max(sets_hz, arrival) FILTER (WHERE sets_hz IS NOT NULL), any_value(c_acctbal)) AS sample_frequency
      FROM eff GROUP BY 1""",
    "command_logs": COMMAND_LOGS,
    # ---- streams ----
    "stream_ingest": STREAMED,
    "stream_requeue": STREAMED,
    "stream_maintained": STREAMED,
    "stream_counters": f"""WITH {READINGS}, {MALFORMED}, {KNOWN},
      r AS (SELECT readings.*, id FROM readings LEFT JOIN known USING (serial_number)
        WHERE batch_id NOT IN (SELECT batch_id FROM malformed)),
      bad AS (SELECT DISTINCT batch_id FROM r WHERE id IS NULL)
      SELECT CASE WHEN batch_id IN (SELECT batch_id FROM bad) THEN 'error' ELSE 'success' END AS status, serial_number,
        count(*) AS value FROM r GROUP BY 1, 2""",
    "stream_dedup": f"WITH {READINGS} SELECT serial_number, time, measurement FROM readings",
    "stream_registry": "SELECT c_name AS serial_number, c_acctbal AS sample_frequency FROM customer WHERE c_acctbal > 0",
    "stream_logs": PARSED_LOGS,
    "stream_commands": f"""WITH {COMMANDS}, {STATE} SELECT serial_number, arrival, was_asleep, was_hz,
      coalesce(sets_asleep, was_asleep) AS asleep, coalesce(sets_hz, was_hz) AS hz FROM tl""",
    "stream_reports": COMMAND_LOGS,
    "stream_reports_folded": COMMAND_LOGS,
    "stream_pack": f"""WITH {READINGS} SELECT serial_number, date_trunc('second', time)::TIMESTAMP AS period_start, time, measurement
      FROM readings""",
}
