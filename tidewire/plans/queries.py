"""Every operator as a runnable query over the benchmark tables: name -> (spark, sf_dir) -> DataFrame.

Sums and means of doubles are rounded, since the order of summation is not fixed: sums of decimal
fractions to the six digits they have, means to nine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ratios, text
from ..functions.timing import bucket, instant
from ..operators import commands as cmd
from ..operators import decode, health, ingest, lifecycle, metrics, registry, scan, series, snapshots
from ..session import configure
from ..streaming import progress
from . import bindings as b
from . import stored, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def r6(col):
    return F.round(col, 6)


def r9(col):
    return F.round(col, 9)


# ---- series ---------------------------------------------------------------------------------------

@query
def series_gapfill(spark, sf):
    out = series.gapfill_avg(b.measurement(spark, sf), b.sensor(spark, sf), "1 hour", *b.RANGE)
    return out.withColumn("measurement", r9("measurement"))


@query
def series_raw(spark, sf):
    return series.read_series(b.measurement(spark, sf), b.sensor(spark, sf))


@query
def series_raw_range(spark, sf):
    """The chosen serials are those of the sensors with a valid frequency."""
    return series.read_series(b.measurement(spark, sf), b.sensor(spark, sf), serials=b.valid_sensor(spark, sf),
                              start=b.RANGE[0], end=b.RANGE[1])


@query
def series_list_range(spark, sf):
    """Some serials by name, in a range that begins and ends inside the data and inside chunks."""
    names = [r.serial_number for r in b.sensor(spark, sf).where(F.col("id").isin(b.CHOSEN)).collect()]
    return series.read_series(lifecycle.with_chunk(b.measurement(spark, sf), width="1 day"), b.sensor(spark, sf), names,
                              *b.INNER_RANGE, chunk="1 day")


@query
def bucket_weekly(spark, sf):
    out = series.bucket_avg(b.measurement(spark, sf), "1 week")
    return out.select("bucket", "sensor_id", r9("measurement").alias("measurement"), "n")


@query
def panel_reducers(spark, sf):
    """Reducers over each sensor's gap-filled hourly series."""
    grid = series.gapfill_avg(b.measurement(spark, sf), b.sensor(spark, sf), "1 hour", *b.RANGE, ordered=False)
    out = series.reduce(grid.withColumn("measurement", r9("measurement")), "measurement", "time", ["serial_number"])
    return out.select("serial_number", F.col("lastNotNull").alias("last_not_null"), F.col("last").alias("last_value"),
                      r9("mean").alias("mean_value"), F.col("max").alias("max_value"),
                      r6("sum").alias("sum_value"), r6("p99").alias("p99_value"))


@query
def latest_per_key(spark, sf):
    return series.latest_by(b.measurement(spark, sf), ["sensor_id"], "time")


@query
def latest_stored(spark, sf):
    """The newest measurement of every registered sensor of a stored table, reading the newest chunks only."""
    return stored.latest(spark, sf)


@query
def panel_percentiles(spark, sf):
    """Reducers and exact percentiles over all measurements as one group."""
    m = b.measurement(spark, sf)
    p50, p95 = series.percentiles(m, "measurement", (0.5, 0.95))
    out = series.reduce(m, "measurement", "time", calcs=("max", "p99"))
    return out.select(F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"), r6("p99").alias("p99"), "max").withColumn(
        "p50", r6("p50")).withColumn("p95", r6("p95"))


@query
def sensor_counts(spark, sf):
    out = series.sensor_counts(b.measurement(spark, sf), b.sensor(spark, sf))
    return out.withColumn("expected_rows", r6("expected_rows"))


@query
def insert_rate(spark, sf):
    out = series.insert_rate(b.measurement(spark, sf), b.sensor(spark, sf), *b.RANGE)
    return out.withColumn("rows_per_second", F.round("rows_per_second", 9))


@query
def sensor_lag(spark, sf):
    """Lag of every registered sensor with its three bands; silent sensors have none."""
    out = series.sensor_lag(b.measurement(spark, sf), b.sensor(spark, sf), b.AS_OF)
    lag = F.col("lag_seconds")
    return out.select("serial_number", "last_time", r6("lag_seconds").alias("lag_seconds"),
                      *[health.band(lag, f"sensor_lag:{p}").alias(f"band_{p}") for p in ("summary", "detail", "alert")])


# ---- registry -------------------------------------------------------------------------------------

@query
def sensor_lookup(spark, sf):
    """Id and frequency for the serial of every event; sensors with an invalid frequency are not found."""
    return registry.lookup(b.named_events(spark, sf), b.valid_sensor(spark, sf))


@query
def sensor_list(spark, sf):
    return registry.sensor_list(b.sensor(spark, sf))


@query
def target_list(spark, sf):
    return registry.target_list(b.target(spark, sf))


@query
def table_scan(spark, sf):
    return b.sensor(spark, sf)


@query
def semi_exists(spark, sf):
    """Sensors for which a measurement exists."""
    m = b.measurement(spark, sf).select(F.col("sensor_id").alias("id"))
    return ingest.existing(b.sensor(spark, sf), m, ["id"])


@query
def registry_new(spark, sf):
    """Register every customer, some twice, against a registry that holds the valid sensors."""
    known = b.valid_sensor(spark, sf)
    first = b.sensor(spark, sf).select("serial_number", "sample_frequency", F.col("id").alias("arrival"))
    again = first.select("serial_number", F.lit(1.0).alias("sample_frequency"),
                         (F.col("arrival") + 1_000_000_000).alias("arrival"))
    return registry.insert_missing(first.unionByName(again), known, "serial_number", ["arrival"])


@query
def target_new(spark, sf):
    """Register the customers' segments and nation names as targets next to the existing nations."""
    c, n = b.load(spark, sf, "customer"), b.target(spark, sf)
    wanted = c.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("arrival")).unionByName(
        n.select("name", F.col("id").cast("bigint").alias("arrival")))
    return registry.insert_missing(wanted, n.select("id", "name"), "name", ["arrival"])


@query
def cascade_delete(spark, sf):
    """Rows per table after the targets of region 0 and everything below them are deleted."""
    targets = b.target(spark, sf)
    frames = {"target": targets, "sensor": b.sensor(spark, sf), "measurement": b.measurement(spark, sf)}
    left = registry.delete_cascade(frames, "target", targets.where("region_id = 0"))
    counts = [left[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count")) for n in frames]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def cascade_queries(spark, sf):
    """Statement history after the query texts of one role are deleted."""
    queries, hist = b.history_queries(spark, sf), b.statement_history(spark, sf)
    _, left = registry.delete_queries(queries, hist, queries.where("rolname = 'role_A'"))
    return left.select("created", "queryid", "datname", "rolname", "calls")


# ---- text rules -----------------------------------------------------------------------------------

@query
def serial_validity(spark, sf):
    """Validity of texts cut and joined from the names of customers, nations, brands and suppliers."""
    c, p = b.load(spark, sf, "customer"), b.load(spark, sf, "part")
    n, s = b.load(spark, sf, "nation"), b.load(spark, sf, "supplier")
    texts = (
        c.select(F.explode(F.array("c_name", F.substring("c_name", 1, 8), F.substring("c_name", 12, 7),
                                   F.concat(F.lit("AAD-"), F.substring("c_name", 15, 4)),
                                   F.concat(F.lit("ñ½-"), F.substring("c_name", 16, 3)),
                                   F.concat(F.substring("c_name", 1, 3), F.lit("\n")))).alias("t"))
        .unionByName(p.select(F.col("p_brand").alias("t"))).unionByName(p.select(F.col("p_type").alias("t")))
        .unionByName(n.select(F.col("n_name").alias("t"))).unionByName(s.select(F.substring("s_name", 1, 4).alias("t")))
    ).distinct()
    return texts.select(F.col("t").alias("serial_text"), text.validate_serial(F.col("t")).alias("valid"))


@query
def constraint_split(spark, sf):
    checked = b.sensor(spark, sf).withColumn("violations", decode.violations(decode.SENSOR_RULES))
    return checked.select("id", F.concat_ws(",", "violations").alias("violations"),
                          (F.size("violations") == 0).alias("accepted"))


@query
def topic_routes(spark, sf):
    t = b.topics(spark, sf)
    return t.select("topic", F.concat_ws(",", decode.matched_routes(F.col("topic"))).alias("routes"))


@query
def command_validity(spark, sf):
    rows, _ = decode.commands(b.raw_commands(spark, sf))
    return cmd.classify(rows).groupBy("command", "known", "accepted").agg(F.count("*").alias("n"))


# ---- messages -------------------------------------------------------------------------------------

@query
def decode_measurements(spark, sf):
    rows, _ = decode.measurements(b.raw_measurements(spark, sf))
    return rows.select("batch_id", "pos", "serial_number", F.col("time").cast("timestamp_ntz").alias("time"),
                       "measurement")


@query
def malformed_messages(spark, sf):
    _, broken = decode.measurements(b.raw_measurements(spark, sf))
    return broken.select("batch_id")


@query
def decode_registry(spark, sf):
    rows, _ = decode.registrations(b.raw_registrations(spark, sf))
    return rows


@query
def decode_logs(spark, sf):
    rows, _ = decode.logs(b.raw_logs(spark, sf))
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def decode_commands(spark, sf):
    rows, _ = decode.commands(b.raw_commands(spark, sf))
    return rows.select("arrival", "serial_number", F.col("time").cast("timestamp_ntz").alias("time"), "command",
                       F.col("params")[cmd.FREQUENCY_PARAM].alias("frequency_param"))


@query
def unnest_arrays(spark, sf):
    """Parallel arrays of each message, as the insert statement receives them, back to rows."""
    packed = b.readings(spark, sf).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("arrival", "time", "serial_number", "measurement"))).alias("r"))
    arrays = packed.select("batch_id", F.col("r.time").alias("time"), F.col("r.serial_number").alias("serial_number"),
                           F.col("r.measurement").alias("measurement"))
    return decode.unnest_arrays(arrays, ["time", "serial_number", "measurement"])


@query
def logfmt_roundtrip(spark, sf):
    rows, _ = decode.logs(b.raw_logs(spark, sf))
    lines = decode.log_lines(rows)
    parsed = decode.parse_log_lines(lines)
    return parsed.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def log_lines(spark, sf):
    rows, _ = decode.logs(b.raw_logs(spark, sf))
    return decode.log_lines(rows).select(F.col("value").alias("line"))


@query
def pack_payload(spark, sf):
    """Readings per message when packed by sensor and hour, read back from the payload."""
    e = b.named_events(spark, sf).select("serial_number", F.col("ts").alias("time"),
                                         F.col("value").alias("measurement"))
    packed = decode.pack(e, "1 second")
    back = F.from_json("value", "array<struct<Timestamp:timestamp_ntz,SerialNumber:string,Value:double>>")
    return packed.select("serial_number", "period_start", F.size(back).alias("n"),
                         r6(F.aggregate(back, F.lit(0.0), lambda a, r: a + r["Value"])).alias("total"),
                         back[0]["Timestamp"].alias("first_time"))


# ---- ingest ---------------------------------------------------------------------------------------

@query
def ingest_strict(spark, sf):
    rows, _ = ingest.enrich(b.readings(spark, sf), b.valid_sensor(spark, sf), "strict")
    return ingest.to_records(rows, ["batch_id"])


@query
def ingest_strict_rejected(spark, sf):
    _, bad = ingest.enrich(b.readings(spark, sf), b.valid_sensor(spark, sf), "strict")
    return bad.select("batch_id", "serial_number", "time", "measurement")


@query
def ingest_quarantine(spark, sf):
    rows, bad = ingest.enrich(b.readings(spark, sf), b.valid_sensor(spark, sf), "quarantine")
    good = rows.select("time", "serial_number", "sensor_id", F.lit("written").alias("outcome"))
    return good.unionByName(bad.select("time", "serial_number", "sensor_id", F.lit("quarantined").alias("outcome")))


def _conflicting_batch(spark, sf):
    """All records, each followed later by a copy with another value, and the records already stored."""
    m = b.load(spark, sf, "events").select(
        F.col("ts").alias("time"), F.col("user_id").alias("sensor_id"), F.col("value").alias("measurement"),
        F.col("event_id").alias("arrival"))
    copy = m.withColumn("measurement", F.col("measurement") + 1000).withColumn("arrival", F.col("arrival") + 10**12)
    held = m.where(F.col("time") < instant("2024-01-08 00:00:00")).drop("arrival") \
        .withColumn("measurement", -F.col("measurement"))
    return m.unionByName(copy), held


@query
def ingest_dedup(spark, sf):
    """The table after an idempotent append: what was stored stays, else the first arrival is kept."""
    batch, held = _conflicting_batch(spark, sf)
    return held.unionByName(ingest.resolve(batch, held, schemas.KEYS["measurement"], ["arrival"], "ignore"))


@query
def append_modes(spark, sf):
    """Keys on which an append in error mode would fail."""
    batch, held = _conflicting_batch(spark, sf)
    return ingest.duplicate_keys(batch, held, schemas.KEYS["measurement"])


@query
def late_flag(spark, sf):
    return ingest.late_flag(b.measurement(spark, sf), b.AS_OF, 7 * 86_400 * 1_000_000)


@query
def batch_stats(spark, sf):
    stats = ingest.batch_stats(b.readings(spark, sf))
    out = ingest.end_to_end_seconds(stats, instant(b.AS_OF))
    return out.withColumn("latency_seconds", r6("latency_seconds"))


# ---- metrics --------------------------------------------------------------------------------------

@query
def counter_totals(spark, sf):
    return metrics.counter(b.status_events(spark, sf), ["status", "user_id"])


@query
def counter_running(spark, sf):
    """Latest scraped value per series, summed over instances for successes."""
    latest = metrics.latest_samples(b.processed_samples(spark, sf), ["status", "instance", "user_id"])
    return metrics.select_labels(latest, status="success").groupBy("user_id").agg(F.sum("value").alias("value"))


@query
def counter_by_event(spark, sf):
    """Counter value per (status, sensor) after every event."""
    events = b.status_events(spark, sf).select("status", "user_id", "ts", F.lit(1).alias("n"))
    out = scan.running_sum_by_block(events, ["status", "user_id"], "ts", ["n"], "7 days")
    return out.select("status", "user_id", "ts", F.col("run_n").alias("value"))


@query
def metric_samples(spark, sf):
    return b.processed_samples(spark, sf)


@query
def histogram_build(spark, sf):
    out = metrics.histogram(b.status_events(spark, sf), "value", b.VALUE_BOUNDS, ["user_id"])
    return out.select("user_id", F.when(F.col("le") == metrics.INF, -1.0).otherwise(F.col("le")).alias("le"),
                      "bucket_count", F.col("count").alias("total_count"), r6("sum").alias("total_sum"))


@query
def batch_size_histogram(spark, sf):
    """Messages received, by their number of readings."""
    sizes = decode.message_sizes(b.raw_measurements(spark, sf))
    out = metrics.histogram(sizes, "batch_size", metrics.exponential_bounds(*metrics.BATCH_SIZE_BUCKETS))
    return out.select(F.when(F.col("le") == metrics.INF, -1.0).otherwise(F.col("le")).alias("le"), "bucket_count",
                      F.col("count").alias("messages"), F.col("sum").alias("readings"))


@query
def latency_histogram(spark, sf):
    """End-to-end latency per sensor, a message being complete when its last reading was taken."""
    rows = b.readings(spark, sf)
    done = rows.groupBy("batch_id").agg(F.max("time").alias("completed"))
    stats = ingest.end_to_end_seconds(ingest.batch_stats(rows).join(done, "batch_id"), F.col("completed"))
    out = metrics.histogram(stats, "latency_seconds", metrics.exponential_bounds(*metrics.END_TO_END_SECONDS_BUCKETS),
                            ["serial_number"])
    return out.select("serial_number", F.when(F.col("le") == metrics.INF, -1.0).otherwise(r6("le")).alias("le"),
                      "bucket_count", F.col("count").alias("observations"), r6("sum").alias("total_seconds"))


_QUANTILES = (0.5, 0.95, 0.99)


@query
def processing_histogram(spark, sf):
    """Processing time of messages per replica, over the declared buckets."""
    out = progress.histogram(b.processing(spark, sf))
    return out.select("query", F.when(F.col("le") == metrics.INF, -1.0).otherwise(r6("le")).alias("le"), "bucket_count",
                      F.col("count").alias("messages"), r6("sum").alias("total_seconds"))


@query
def processing_quantiles(spark, sf):
    out = progress.histogram(b.processing(spark, sf)).withColumn("rate", F.col("bucket_count").cast("double"))
    q = metrics.histogram_quantile(out, _QUANTILES, ["query"])
    return q.select("query", *[r6(metrics.quantile_name(x)).alias(metrics.quantile_name(x)) for x in _QUANTILES])


_SERIES = ["status", "instance", "user_id"]


@query
def counter_rate(spark, sf):
    """Per-sensor success rate over six hours, every two hours."""
    ok = metrics.select_labels(b.processed_samples(spark, sf), status="success")
    out = metrics.sum_by(metrics.rate(ok, _SERIES, "6 hours", "2 hours"), "rate", ["user_id"])
    return out.select("step", "user_id", F.round("rate", 9).alias("rate"))


@query
def counter_rate_total(spark, sf):
    ok = metrics.select_labels(b.processed_samples(spark, sf), status="success")
    out = metrics.sum_by(metrics.rate(ok, _SERIES, "6 hours", "2 hours"), "rate")
    return out.select("step", F.round("rate", 9).alias("rate"))


@query
def counter_rate_extrapolated(spark, sf):
    """The same with the stretch towards the range borders."""
    out = metrics.sum_by(
        metrics.rate(b.processed_samples(spark, sf), _SERIES, "6 hours", "2 hours", extrapolate=True), "rate",
        ["status"])
    return out.select("step", "status", F.round("rate", 9).alias("rate"))


@query
def instant_rate(spark, sf):
    r = metrics.irate(metrics.select_labels(b.published_samples(spark, sf), protocol="stream"),
                      ["protocol", "instance"], "3 hours", "1 hour")
    return metrics.sum_by(r, "rate").select("step", F.round("rate", 9).alias("rate"))


@query
def histogram_quantile(spark, sf):
    r = metrics.rate(b.value_buckets(spark, sf), ["instance", "le"], "6 hours", "1 hour")
    per_le = metrics.sum_by(r, "rate", ["le"])
    q = metrics.histogram_quantile(per_le, _QUANTILES)
    return q.select("step", *[r6(metrics.quantile_name(x)).alias(metrics.quantile_name(x)) for x in _QUANTILES])


@query
def histogram_quantile_by_sensor(spark, sf):
    r = metrics.rate(b.value_buckets(spark, sf, ["user_id"], "1 day"), ["user_id", "le"], "7 days", "1 day",
                     block="14 days")
    q = metrics.histogram_quantile(metrics.sum_by(r, "rate", ["user_id", "le"]), (0.95,), ["step", "user_id"])
    return q.select("step", "user_id", r6("q95").alias("q95"))


@query
def success_rate(spark, sf):
    out = metrics.success_rate(b.processed_samples(spark, sf), ["instance", "user_id"], "12 hours", "3 hours")
    return out.select("step", r6("success_pct").alias("success_pct"),
                      health.band(r6("success_pct"), "success_pct:dashboard").alias("band"))


@query
def success_rate_extrapolated(spark, sf):
    out = metrics.success_rate(b.processed_samples(spark, sf), ["instance", "user_id"], "12 hours", "3 hours", extrapolate=True)
    return out.select("step", r6("success_pct").alias("success_pct"))


@query
def publish_vs_process(spark, sf):
    published = metrics.sum_by(metrics.irate(b.published_samples(spark, sf), ["protocol", "instance"], "3 hours",
                                             "1 hour"), "rate")
    ok = metrics.select_labels(b.processed_samples(spark, sf), status="success")
    processed = metrics.sum_by(metrics.rate(ok, _SERIES, "2 hours", "1 hour"), "rate")
    out = metrics.backlog(published, processed)
    return out.select("step", *[F.round(c, 9).alias(c) for c in ("published", "processed", "backlog")])


@query
def panel_overlay(spark, sf):
    """Success and error rates of all sensors as one long frame."""
    r = metrics.rate(b.processed_samples(spark, sf), _SERIES, "6 hours", "2 hours")
    parts = {s: metrics.sum_by(metrics.select_labels(r, status=s), "rate") for s in ("success", "error")}
    return metrics.overlay(**parts).select("series", "step", F.round("rate", 9).alias("rate"))


@query
def latency_targets(spark, sf):
    """Quantiles and success share per step against the ingester's targets."""
    r = metrics.rate(b.value_buckets(spark, sf), ["instance", "le"], "6 hours", "3 hours")
    q = metrics.histogram_quantile(metrics.sum_by(r, "rate", ["le"]), _QUANTILES)
    ok = metrics.success_rate(b.processed_samples(spark, sf), ["instance", "user_id"], "12 hours", "3 hours")
    out = health.check_targets(q.join(ok, "step"))
    return out.withColumn("value", r6("value"))


# ---- snapshots ------------------------------------------------------------------------------------

def _base(spark, sf, datname=snapshots.DATABASE):
    return snapshots.statement_base(b.statements(spark, sf), b.kcache(spark, sf), b.roles(spark, sf),
                                    b.databases(spark, sf), datname)


def _rounded(df, cols):
    return df.select(*[F.round(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


@query
def statement_base(spark, sf):
    out = snapshots.statement_rows(_base(spark, sf, None), b.AS_OF)
    return _rounded(out, schemas.DOUBLE_COUNTERS)


@query
def snapshot_totals(spark, sf):
    out = snapshots.snapshot_totals(_base(spark, sf), b.AS_OF, "2024-01-01 00:00:00")
    return _rounded(out, schemas.DOUBLE_COUNTERS)


@query
def query_dim(spark, sf):
    """Query texts a tick would add to the ones already known (those of db_A)."""
    known = snapshots.query_dim(_base(spark, sf, "db_A"))
    now = snapshots.query_dim(_base(spark, sf, None))
    return ingest.only_new(now, known, schemas.KEYS["queries"])


@query
def table_stats_snapshot(spark, sf):
    out = snapshots.table_stats(b.user_tables(spark, sf), b.AS_OF)
    return out.withColumn("dead_tup_ratio", F.col("dead_tup_ratio").cast("double"))


@query
def db_stats_snapshot(spark, sf):
    out = snapshots.database_stats(b.database_counters(spark, sf), b.AS_OF, None)
    return out.withColumn("cache_hit_ratio", F.col("cache_hit_ratio").cast("double"))


@query
def connection_stats(spark, sf):
    return snapshots.connection_stats(b.activity(spark, sf), b.AS_OF, None)


@query
def cache_and_connections(spark, sf):
    """Connections by state of the observed database next to its cache hit ratio and band."""
    db = snapshots.database_stats(b.database_counters(spark, sf), b.AS_OF)
    conn = snapshots.latest_connections(snapshots.connection_stats(b.activity(spark, sf), b.AS_OF))
    ratio = F.col("cache_hit_ratio").cast("double")
    return conn.join(db.select("datname", "cache_hit_ratio"), "datname").select(
        "datname", "state", "connection_count", ratio.alias("cache_hit_ratio"),
        health.band(ratio, "cache_hit:detail").alias("band"))


@query
def foreign_table_stats(spark, sf):
    """Table statistics of the foreign source, under their qualified names."""
    t = b.user_tables(spark, sf).where(F.col("schemaname").isin(list(snapshots.TABLE_SCHEMAS)))
    return t.select(snapshots.table_key().alias("table_key"), "n_live_tup", "n_dead_tup", "last_autovacuum")


@query
def size_snapshot(spark, sf):
    return snapshots.size_rows(b.table_sizes(spark, sf), b.AS_OF)


@query
def history_append(spark, sf):
    """Connection history after a tick is recorded twice, against a history that holds one state already."""
    tick = snapshots.connection_stats(b.activity(spark, sf), b.AS_OF, None)
    held = tick.where("state = 'idle'").withColumn("connection_count", F.lit(-1))
    once = snapshots.append_new(held, tick, schemas.KEYS["connection_stats"])
    return snapshots.append_new(once, tick, schemas.KEYS["connection_stats"])


@query
def snapshot_take(spark, sf):
    """Rows every history table receives from one tick."""
    frames = snapshots.take(
        {"statements": b.statements(spark, sf), "kcache": b.kcache(spark, sf), "roles": b.roles(spark, sf),
         "databases": b.databases(spark, sf), "tables": b.user_tables(spark, sf),
         "database": b.database_counters(spark, sf), "activity": b.activity(spark, sf),
         "sizes": b.table_sizes(spark, sf)}, b.AS_OF)
    out = None
    for name, df in frames.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        out = n if out is None else out.unionByName(n)
    return out


#: The histories are monthly: a block holds a dozen records of a key.
_MONTHLY_BLOCK = "366 days"
_DELTA_COUNTERS = ["calls", "total_exec_time", "rows"]


def _deltas(spark, sf):
    return snapshots.delta(b.statement_history(spark, sf), schemas.KEYS["queries"], _DELTA_COUNTERS, "stats_reset",
                           block=_MONTHLY_BLOCK)


@query
def snapshot_delta(spark, sf):
    return _rounded(_deltas(spark, sf), {"d_total_exec_time"})


@query
def slowest_queries(spark, sf):
    out = snapshots.slowest(_deltas(spark, sf), b.history_queries(spark, sf), 10)
    return _rounded(out, {"total_exec_time", "mean_exec_time"})


@query
def size_growth(spark, sf):
    return snapshots.size_growth(b.size_history(spark, sf), block=_MONTHLY_BLOCK)


@query
def dead_rows(spark, sf):
    out = health.dead_rows(health.like(b.user_tables(spark, sf), "relname", "sensor_measurement"))
    return out.select("relname", "dead_tuples", "live_tuples", r6("dead_pct").alias("dead_pct"),
                      health.band(r6("dead_pct"), "dead_pct:detail").alias("band"))


def _table_history(spark, sf):
    """Two ticks of the table statistics, a day apart; the second has a dead row more."""
    t = b.user_tables(spark, sf)
    later = t.withColumn("n_dead_tup", F.col("n_dead_tup") + 1)
    return snapshots.table_stats(t, b.INNER_RANGE[1]).unionByName(snapshots.table_stats(later, b.AS_OF))


@query
def dead_rows_history(spark, sf):
    out = health.dead_rows_history(_table_history(spark, sf))
    return out.withColumn("dead_pct", r6("dead_pct"))


@query
def dead_rows_latest(spark, sf):
    out = health.dead_rows_history(_table_history(spark, sf), latest=True)
    return out.withColumn("dead_pct", r6("dead_pct"))


@query
def autovacuum_list(spark, sf):
    return health.autovacuum_list(health.like(b.user_tables(spark, sf), "relname", "sensor_measurement"))


@query
def buffer_top(spark, sf):
    out = snapshots.buffered_top(b.buffers(spark, sf), b.classes(spark, sf), b.databases(spark, sf))
    return out.withColumn("buffered", text.size_pretty(F.col("buffered_bytes")))


# ---- lifecycle ------------------------------------------------------------------------------------

def _chunked(spark, sf):
    return lifecycle.with_chunk(b.measurement(spark, sf))


@query
def chunk_assignment(spark, sf):
    return _chunked(spark, sf)


@query
def chunk_catalog(spark, sf):
    out = lifecycle.chunk_catalog(_chunked(spark, sf), b.AS_OF)
    return out.withColumn("age_minutes", r6("age_minutes"))


@query
def chunk_distribution(spark, sf):
    return lifecycle.chunk_distribution(lifecycle.chunk_catalog(_chunked(spark, sf), b.AS_OF))


@query
def newest_chunks(spark, sf):
    out = lifecycle.newest_chunks(lifecycle.chunk_catalog(_chunked(spark, sf), b.AS_OF))
    return out.select("chunk_start", "hash_part", "chunk_end", "compacted", r6("age_minutes").alias("age_minutes"))


@query
def retention(spark, sf):
    """Measurements kept by a seven-day retention over chunks of a day."""
    return lifecycle.retained(b.measurement(spark, sf), "7 days", "2024-01-30 12:00:00", width="1 day")


@query
def skip_scan(spark, sf):
    """Every chunk of a stored table with whether its catalog lets a scan for ten sensors skip it."""
    return stored.skipping(spark, sf)


@query
def pruned_scan(spark, sf):
    """The rows of ten sensors in a time range, read by literal partition filters from the chunks the catalog names."""
    return stored.pruned(spark, sf)


@query
def sensor_range_scan(spark, sf):
    return stored.narrow(spark, sf)


@query
def catalog_listing(spark, sf):
    """The stored catalog of a table after appends, a compaction, and late appends to compacted chunks."""
    return stored.listing(spark, sf)


@query
def retention_stored(spark, sf):
    return stored.retained(spark, sf)


@query
def delete_stored(spark, sf):
    return stored.deleted(spark, sf)


@query
def ingest_stored(spark, sf):
    """`ingest_dedup` on a stored table, with a reading a year late in every batch."""
    return stored.appended(spark, *_conflicting_batch(spark, sf))


@query
def compaction(spark, sf):
    """The rows in columnar order: the same rows as before."""
    return lifecycle.compacted_layout(_chunked(spark, sf))


@query
def compression_ratio(spark, sf):
    """Bytes of the chunks as rows of fixed width against one stored value per distinct sensor and row."""
    chunked = _chunked(spark, sf)
    sizes = chunked.groupBy("chunk_start", "hash_part", "sensor_id").agg(F.count("*").alias("n")) \
        .groupBy("chunk_start", "hash_part").agg((F.sum("n") * 20).alias("bytes_before"),
                                                 (F.count("*") * 4 + F.sum("n") * 16).alias("bytes_after"))
    catalog = sizes.withColumn("compacted", lifecycle.expired("chunk_start", lifecycle.MEASUREMENT_CHUNK, "15 minutes",
                                                              b.AS_OF)) \
        .withColumn("table_name", F.lit("sensor_measurement"))
    return lifecycle.compression_ratio(catalog).withColumn("ratio", r6("ratio"))


# ---- health ---------------------------------------------------------------------------------------

@query
def like_filter(spark, sf):
    return health.like(b.user_tables(spark, sf), "relname", "sensor_measurement").select("relid", "relname")


@query
def stale_sessions(spark, sf):
    out = health.stale_sessions(b.activity(spark, sf), "2002-01-01 00:00:00")
    return out.select("pid", "datname", "query", r6("seconds_in_state").alias("seconds_in_state"))


@query
def long_running(spark, sf):
    out = health.long_running(b.activity(spark, sf), "2002-01-01 00:00:00")
    return out.select("pid", r6("seconds").alias("seconds"), "level")


@query
def null_safe_ratio(spark, sf):
    t = b.user_tables(spark, sf)
    return t.select("relid", r6(ratios.null_safe_pct(F.col("n_dead_tup"), F.col("n_live_tup"))).alias("dead_pct"))


@query
def blocking_pairs(spark, sf):
    return health.blocking_pairs(b.locks(spark, sf), b.supplier_sessions(spark, sf))


@query
def health_bands(spark, sf):
    """Every band preset over the values of the table, database, sensor and event statistics."""
    dead = F.col("d.dead_tup_ratio").cast("double")
    t = snapshots.table_stats(b.user_tables(spark, sf), b.AS_OF).alias("d").select(
        F.col("relname").alias("key"), F.lit("dead_pct").alias("kind"), dead.alias("value"),
        health.band(dead, "dead_pct:summary").alias("summary"), health.band(dead, "dead_pct:detail").alias("detail"),
        health.band(dead, "dead_pct:alert").alias("alert"))
    hit = F.col("cache_hit_ratio").cast("double")
    c = snapshots.database_stats(b.database_counters(spark, sf), b.AS_OF, None).select(
        F.col("datname").alias("key"), F.lit("cache_hit").alias("kind"), hit.alias("value"),
        health.band(hit, "cache_hit:summary").alias("summary"), health.band(hit, "cache_hit:detail").alias("detail"),
        health.band(hit, "cache_hit:alert").alias("alert"))
    return t.unionByName(c)


@query
def gauge_bands(spark, sf):
    """Dashboard gauges over daily event counts and errors."""
    daily = b.status_events(spark, sf).groupBy(bucket("ts", "1 day").alias("day")).agg(
        F.count("*").cast("double").alias("throughput"),
        F.count_if(F.col("status") == "error").cast("double").alias("errors"))
    return daily.select("day", "throughput", "errors",
                        health.band(F.col("throughput"), "throughput:dashboard").alias("throughput_band"),
                        health.band(F.col("errors"), "errors:dashboard").alias("errors_band"))


@query
def alerts(spark, sf):
    m = b.measurement(spark, sf)
    chunks = lifecycle.with_chunk(m, width="1 day").groupBy(F.col("chunk_start").alias("created")).agg(
        F.count_distinct("hash_part").alias("chunks")).withColumn("table_name", F.lit("sensor_measurement"))
    out = health.alerts({
        "sensor_lag": series.sensor_lag(m, b.sensor(spark, sf), b.AS_OF),
        "cache": snapshots.database_stats(b.database_counters(spark, sf), b.AS_OF, None),
        "dead": snapshots.table_stats(b.user_tables(spark, sf), b.AS_OF).withColumn("dead_pct", F.col("dead_tup_ratio")),
        "connections": snapshots.connection_stats(b.activity(spark, sf), b.AS_OF, None),
        "chunks": chunks,
    })
    return out.withColumn("value", r6("value"))


@query
def io_quadrant(spark, sf):
    out = health.io_quadrant(_base(spark, sf, None), 300, 50000)
    return out.groupBy("quadrant").agg(F.count("*").alias("n"), F.sum("shared_blks_written").alias("blks_written"))


# ---- commands -------------------------------------------------------------------------------------

def _commands(spark, sf):
    rows, _ = decode.commands(b.raw_commands(spark, sf))
    initial = b.sensor(spark, sf).select("serial_number", F.lit(False).alias("asleep"), "sample_frequency")
    return rows, initial


@query
def command_state(spark, sf):
    return cmd.final_state(*_commands(spark, sf))


@query
def command_logs(spark, sf):
    _, logs = cmd.fold(*_commands(spark, sf))
    return logs.withColumn("time", F.col("time").cast("timestamp_ntz"))


# ---- streams, run to completion over the tables -----------------------------------------------------

@query
def stream_ingest(spark, sf):
    """Measurement messages through the streaming ingest, replayed once: the table it leaves."""
    return streams.ingest(spark, sf)


@query
def stream_requeue(spark, sf):
    """The table after readings of half the sensors arrived before their sensor was registered."""
    return streams.requeued(spark, sf)


@query
def stream_maintained(spark, sf):
    """The table that the ingest leaves when it compacts and trims between its micro-batches."""
    return streams.maintained(spark, sf)


@query
def stream_counters(spark, sf):
    """Outcome counters of the streaming ingest."""
    return streams.counters(spark, sf)


@query
def stream_dedup(spark, sf):
    """Resent readings removed in the stream."""
    return streams.dedup(spark, sf)


@query
def stream_registry(spark, sf):
    return streams.registrations(spark, sf)


@query
def stream_logs(spark, sf):
    return streams.logs(spark, sf)


@query
def stream_commands(spark, sf):
    return streams.commands(spark, sf)


@query
def stream_reports(spark, sf):
    """Log records the commands cause, from the keyed stream."""
    return streams.reports(spark, sf, "keyed")


@query
def stream_reports_folded(spark, sf):
    """The same from the stream that folds each micro-batch as a whole."""
    return streams.reports(spark, sf, "folded")


@query
def stream_pack(spark, sf):
    return streams.pack(spark, sf)
