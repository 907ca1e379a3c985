"""Health bands, alerts and the listings an operator looks at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import Band, banded, null_safe_pct
from ..functions.timing import instant, micros, seconds_between, width_us
from .scan import lag_by_block

# Threshold tables. The sources of these bands disagree with each other, so each is kept
# as its own preset; the unnamed gap of 30 to 60 seconds in sensor_lag:detail is called critical.
# A band is (name, upper limit, limit included).
PRESETS: dict[str, list[Band]] = {
    "cache_hit:summary": [("critical", 95.0, False), ("warning", 99.0, True), ("healthy", None, False)],
    "cache_hit:detail": [("poor", 90.0, False), ("fair", 95.0, False), ("good", 99.0, False),
                         ("excellent", None, False)],
    "cache_hit:alert": [("critical", 85.0, False), ("warning", 95.0, False), ("ok", None, False)],
    "dead_pct:summary": [("healthy", 5.0, False), ("warning", 10.0, True), ("critical", None, False)],
    "dead_pct:detail": [("excellent", 5.0, False), ("good", 10.0, False), ("warning", 20.0, True),
                        ("critical", None, False)],
    "dead_pct:alert": [("ok", 10.0, True), ("warning", 20.0, True), ("critical", None, False)],
    "sensor_lag:summary": [("healthy", 5.0, False), ("warning", 30.0, True), ("critical", None, False)],
    "sensor_lag:detail": [("healthy", 5.0, False), ("warning", 15.0, False), ("critical", 60.0, True),
                          ("offline", None, False)],
    "sensor_lag:alert": [("ok", 30.0, True), ("warning", 60.0, True), ("critical", None, False)],
    "idle_in_transaction:summary": [("healthy", 0.0, True), ("warning", 2.0, True), ("critical", None, False)],
    "query_seconds:detail": [("normal", 10.0, True), ("slow", 30.0, True), ("very_slow", None, False)],
    "throughput:dashboard": [("red", 1000.0, False), ("yellow", 10000.0, False), ("green", 40000.0, False),
                             ("blue", None, False)],
    "success_pct:dashboard": [("red", 95.0, False), ("yellow", 99.9, False), ("green", None, False)],
    "errors:dashboard": [("green", 1.0, False), ("red", None, False)],
}
# Targets of the ingester, as (measure, comparison, limit).
TARGETS = [("q50", "<", 0.05), ("q95", "<", 0.1), ("q99", "<", 0.2), ("success_pct", ">", 99.9)]
MAX_CONNECTIONS_SHARE = 0.8


def band(col: Column, preset: str) -> Column:
    return banded(col, PRESETS[preset])


def alerts(frames: Mapping[str, DataFrame], max_connections: int = 50) -> DataFrame:
    """Raised alerts as (rule, severity, key, value).

    `frames` may hold: sensor_lag(serial_number, lag_seconds), cache(datname, cache_hit_ratio),
    dead(relname, dead_pct), connections(datname, connection_count), chunks(chunk_start, chunks).
    """
    parts = []

    def add(df: DataFrame, rule: str, severity: Column, key: str, value: str):
        parts.append(
            df.select(F.lit(rule).alias("rule"), severity.alias("severity"), F.col(key).cast("string").alias("key"),
                      F.col(value).cast("double").alias("value"))
            .where(F.col("severity").isin("critical", "warning"))
        )

    for name, rule, key, value in (
        ("sensor_lag", "sensor_lag", "serial_number", "lag_seconds"),
        ("cache", "cache_hit", "datname", "cache_hit_ratio"),
        ("dead", "dead_pct", "relname", "dead_pct"),
    ):
        if name in frames:
            add(frames[name], rule, band(F.col(value), f"{rule}:alert"), key, value)
    if "connections" in frames:
        used = frames["connections"].groupBy("datname").agg(F.sum("connection_count").alias("used"))
        limit = F.lit(max_connections * MAX_CONNECTIONS_SHARE)
        add(used, "connections", F.when(F.col("used") > limit, F.lit("critical")), "datname", "used")
    if "chunks" in frames:
        add(growing(frames["chunks"]), "chunk_count", F.when(F.col("growing"), F.lit("warning")),
            "table_name", "newest")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def growing(counts: DataFrame) -> DataFrame:
    """Whether a table's chunk count never fell over the observed ticks and ended higher than it began.

    `counts` has (table_name, created, chunks), one row per tick.
    """
    steps = lag_by_block(counts.select("table_name", "created", "chunks"), ["table_name"], "created", ["chunks"],
                         "1 day")
    first, newest = F.min_by("chunks", "created"), F.max_by("chunks", "created")
    rises = F.every(F.coalesce(F.col("chunks") >= F.col("prev_chunks"), F.lit(True)))
    return steps.groupBy("table_name").agg(newest.alias("newest"), (rises & (newest > first)).alias("growing"))


def io_quadrant(df: DataFrame, written_cut: float, writes_cut: float) -> DataFrame:
    """Interpretation of buffer writes against writes seen by the operating system."""
    dirty, flushed = F.col("shared_blks_written") > written_cut, F.col("exec_writes") > writes_cut
    label = (
        F.when(dirty & ~flushed, F.lit("dirtied_not_flushed"))
        .when(~dirty & flushed, F.lit("written_elsewhere"))
        .when(dirty & flushed, F.lit("flushing_to_disk"))
        .when(~dirty & ~flushed, F.lit("mostly_idle"))
    )
    return df.withColumn("quadrant", label)


def stale_sessions(activity: DataFrame, as_of, state: str = "idle in transaction",
                   older_than: str = "1 minute") -> DataFrame:
    """Sessions in a state for longer than the given time, with the time spent in it."""
    now = micros(instant(as_of))
    return (
        activity.where(F.col("state") == state)
        .where(now - micros("state_change") > width_us(older_than))
        .withColumn("seconds_in_state", seconds_between("state_change", instant(as_of)))
    )


def long_running(activity: DataFrame, as_of) -> DataFrame:
    """Active statements that run longer than the first threshold, with their band."""
    seconds = seconds_between("state_change", instant(as_of))
    return (
        activity.where(F.col("state") == "active").withColumn("seconds", seconds)
        .withColumn("level", band(F.col("seconds"), "query_seconds:detail")).where("level <> 'normal'")
    )


def check_targets(measures: DataFrame, targets: Sequence[tuple[str, str, float]] = TARGETS) -> DataFrame:
    """One row per input row and target: the measured value and whether the target is met."""
    checks = []
    for name, op, limit in targets:
        if name in measures.columns:
            value = F.col(name).cast("double")
            met = value < limit if op == "<" else value > limit
            checks.append(F.struct(F.lit(name).alias("measure"), value.alias("value"),
                                   F.lit(float(limit)).alias("target"), met.alias("met")))
    rest = [c for c in measures.columns if c not in {t[0] for t in targets}]
    return measures.select(*rest, F.inline(F.array(*checks)))


def like(df: DataFrame, col: str, part: str) -> DataFrame:
    return df.where(F.col(col).like(f"%{part}%"))


def dead_rows(stats: DataFrame) -> DataFrame:
    """Dead-row percentage per table, NULL without live rows, most dead rows first."""
    return stats.select(
        "relname", F.col("n_dead_tup").alias("dead_tuples"), F.col("n_live_tup").alias("live_tuples"),
        null_safe_pct(F.col("n_dead_tup"), F.col("n_live_tup")).alias("dead_pct"),
    ).orderBy(F.desc("dead_tuples"), "relname")


def dead_rows_history(history: DataFrame, latest: bool = False) -> DataFrame:
    """Dead-row percentage per table over the recorded ticks, NULL without live rows; or of each table's latest tick."""
    if latest:
        counters = F.struct("n_dead_tup", "n_live_tup")
        history = history.groupBy("relname").agg(F.max("created").alias("created"), F.max_by(counters, "created").alias("c")) \
            .select("relname", "created", "c.*")
    return history.select(
        "relname", "created", F.col("n_dead_tup").alias("dead_tuples"), F.col("n_live_tup").alias("live_tuples"),
        null_safe_pct(F.col("n_dead_tup"), F.col("n_live_tup")).alias("dead_pct"))


def autovacuum_list(stats: DataFrame) -> DataFrame:
    """Vacuum activity, never-vacuumed tables first."""
    return top(stats.select("schemaname", "relname", "last_autovacuum", "last_autoanalyze",
                            "autovacuum_count", "autoanalyze_count"), "last_autovacuum", tie=["relname"])


def top(df: DataFrame, col: str, k: int | None = None, nulls: str = "first", tie: Sequence[str] = ()) -> DataFrame:
    """Descending order with NULLs first (or last), cut to k rows when k is given."""
    key = F.desc_nulls_first(col) if nulls == "first" else F.desc_nulls_last(col)
    out = df.orderBy(key, *tie)
    return out if k is None else out.limit(k)


#: What two locks must agree in to be on the same thing (NULL agrees with NULL).
LOCK_IDENTITY = ("locktype", "database", "relation", "transactionid")
#: Locks that a task pairs, or so.
TASK_LOCKS = 250_000


def blocking_pairs(locks: DataFrame, activity: DataFrame, identity: Sequence[str] = LOCK_IDENTITY) -> DataFrame:
    """Which statement waits for which: (blocked, blocking, pairs).

    Two locks on the same thing but of different sessions pair up when the first one is not granted. The
    result lists each pair of statements once with the number of lock pairs behind it. Locks are counted
    per (thing, statement) on both sides before the join, and pairs of a session with itself are taken
    off afterwards, so lock pairs are never enumerated. A session without a text is the statement NULL.

    ``identity=("locktype",)`` pairs locks by type alone, as an operator looking at a few sessions does: filter the
    locks first, since a type is shared by most of them.
    """
    # Locks are dealt by session to shares, and what is left of them by thing: a task holds some `TASK_LOCKS` of them, however many
    # there are, and a thing that many sessions lock has been counted by share and statement before it meets in one task.
    tasks = -(-locks.count() // TASK_LOCKS)
    thing = F.struct(*identity)  # fields that are NULL on both sides are equal
    shared = locks.withColumn("thing", thing).withColumn("share", F.pmod(F.xxhash64("thing", "pid"), F.lit(16 * max(tasks, 1))))
    per_session = _dealt(shared, tasks, "share").groupBy("share", "thing", "pid").agg(
        F.count("*").alias("held"), F.count_if(~F.col("granted")).alias("waiting")
    ).join(activity.select("pid", "query"), "pid")
    # pairs(a, b) = waiting(a) · held(b), minus each session's pairs with itself (there a = b).
    per_share = per_session.groupBy("share", "thing", "query").agg(
        F.sum("held").alias("held"), F.sum("waiting").alias("waiting"),
        F.sum(F.col("held") * F.col("waiting")).alias("own"),
    )
    per_statement = _dealt(per_share, tasks, "thing").groupBy("thing", "query").agg(
        *[F.sum(c).alias(c) for c in ("held", "waiting", "own")])
    blocked = per_statement.where("waiting > 0").select(
        "thing", F.col("query").alias("blocked_statement"), "waiting", "own").alias("w")
    blocking = per_statement.select("thing", F.col("query").alias("blocking_statement"), "held").alias("h")
    same = F.col("blocked_statement").eqNullSafe(F.col("blocking_statement"))
    pairs = F.col("waiting") * F.col("held") - F.when(same, F.col("own")).otherwise(F.lit(0))
    return (
        blocked.join(blocking, F.col("w.thing") == F.col("h.thing")).withColumn("pairs", pairs).where("pairs > 0")
        .groupBy("blocked_statement", "blocking_statement").agg(F.sum("pairs").alias("pairs"))
    )


def _dealt(rows: DataFrame, tasks: int, by: str) -> DataFrame:
    return rows.repartition(tasks, by) if tasks > 1 else rows
