"""Statistics snapshots: what one tick records, and what the recorded history tells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ratios import safe_pct
from ..functions.text import qualified_name
from ..functions.timing import instant
from .ingest import only_new
from .scan import lag_by_block

# What a tick looks at.
DATABASE = "iot"
TABLE_SCHEMAS = ("public", "_timescaledb_internal")
SIZE_TABLE = "detailed"

#: Statement, table and size history is stored in chunks of a day; look-back is cut the same way.
HISTORY_CHUNK = "1 day"

#: Parts that a database's statements are dealt to while its name is joined.
DATABASE_SHARES = 256


def statement_base(stmts: DataFrame, kcache: DataFrame, roles: DataFrame, dbs: DataFrame,
                   datname: str | None = DATABASE) -> DataFrame:
    """Statement counters with their OS counters, role and database names.

    The catalog filter is applied first, so that only one database's statements reach the three-key join. There are few
    databases: each is repeated `DATABASE_SHARES` times and its statements are dealt to one of the copies, so that a join that is
    not broadcast does not gather a database's statements in one task.
    """
    if datname is not None:
        dbs = dbs.where(F.col("datname") == datname)
    dbs = dbs.select(F.col("oid").alias("dbid"), "datname", F.explode(F.sequence(F.lit(0), F.lit(DATABASE_SHARES - 1))).alias("__share"))
    roles = roles.select(F.col("oid").alias("userid"), "rolname")
    keys = ["userid", "dbid", "queryid"]
    share = F.pmod(F.hash("userid", "queryid"), F.lit(DATABASE_SHARES))
    return (
        stmts.withColumn("__share", share).join(dbs, ["dbid", "__share"]).drop("__share")
        .join(kcache.select(*keys, *schemas.KCACHE_COUNTERS), keys)
        .join(roles, "userid")
    )


def snapshot_totals(base: DataFrame, as_of, stats_reset) -> DataFrame:
    """One row with the sum of every counter; no row when there are no statements."""
    sums = base.agg(F.count("*").alias("__n"), *[F.sum(c).alias(c) for c in schemas.SNAPSHOT_COUNTERS])
    return sums.where("__n > 0").select(
        instant(as_of).alias("created"), *schemas.SNAPSHOT_COUNTERS, instant(stats_reset).alias("stats_reset")
    )


def query_dim(base: DataFrame) -> DataFrame:
    """Query texts, one per (queryid, datname, rolname)."""
    return base.groupBy(*schemas.KEYS["queries"]).agg(F.min("query").alias("query"))


def statement_rows(base: DataFrame, as_of) -> DataFrame:
    return base.withColumn("created", instant(as_of)).select(*schemas.STATEMENT_COLUMNS)


def table_stats(src: DataFrame, as_of, schema_names: Sequence[str] = TABLE_SCHEMAS) -> DataFrame:
    """Per-table counters of the given schemas with the dead-row percentage (0 without live rows)."""
    return (
        src.where(F.col("schemaname").isin(list(schema_names)))
        .withColumn("created", instant(as_of))
        .withColumn("dead_tup_ratio", safe_pct(F.col("n_dead_tup"), F.col("n_live_tup"), 0))
        .select(*schemas.TABLE_STATS_COLUMNS)
    )


def database_stats(src: DataFrame, as_of, datname: str | None = DATABASE) -> DataFrame:
    """Per-database counters with the cache hit percentage (100 when nothing was read)."""
    if datname is not None:
        src = src.where(F.col("datname") == datname)
    ratio = safe_pct(F.col("blks_hit"), F.col("blks_hit") + F.col("blks_read"), 100)
    return (
        src.withColumn("created", instant(as_of)).withColumn("cache_hit_ratio", ratio)
        .select(*schemas.DATABASE_STATS_COLUMNS)
    )


def connection_stats(activity: DataFrame, as_of, datname: str | None = DATABASE) -> DataFrame:
    """Sessions per (database, state).

    Grouped by the defaulted state: sessions without a state and sessions whose state is literally
    'unknown' are counted together instead of competing for one key.
    """
    if datname is not None:
        activity = activity.where(F.col("datname") == datname)
    return activity.groupBy(
        instant(as_of).alias("created"), "datname", F.coalesce("state", F.lit("unknown")).alias("state")
    ).agg(F.count("*").cast("int").alias("connection_count"))


def size_rows(sizes: DataFrame, as_of) -> DataFrame:
    """Size record of every table except the size history itself."""
    return sizes.where(F.col("hypertable_name") != SIZE_TABLE).select(
        instant(as_of).alias("created"), "hypertable_name", "table_bytes", "index_bytes", "toast_bytes",
        F.col("total_bytes").alias("total_size"), "node_name",
    )


def table_key(schema: str = "schemaname", table: str = "relname"):
    return qualified_name(F.col(schema), F.col(table))


def take(inputs: Mapping[str, DataFrame], as_of, stats_reset=None, datname: str | None = DATABASE,
         base: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every frame one tick records, keyed by history table, all stamped with the same `as_of`.

    `inputs` may hold any of: statements+kcache+roles+databases, tables, database, activity, sizes.
    `base` replaces the joined statements where the caller has them at hand.
    """
    out: dict[str, DataFrame] = {}
    if base is None and "statements" in inputs:
        base = statement_base(inputs["statements"], inputs["kcache"], inputs["roles"], inputs["databases"],
                              datname)
    if base is not None:
        out["queries"] = query_dim(base)
        out["snapshots"] = snapshot_totals(base, as_of, stats_reset if stats_reset is not None else as_of)
        out["statements"] = statement_rows(base, as_of)
    if "tables" in inputs:
        out["table_stats"] = table_stats(inputs["tables"], as_of)
    if "database" in inputs:
        out["database_stats"] = database_stats(inputs["database"], as_of, datname)
    if "activity" in inputs:
        out["connection_stats"] = connection_stats(inputs["activity"], as_of, datname)
    if "sizes" in inputs:
        out["sizes"] = size_rows(inputs["sizes"], as_of)
    return out


def append_new(history: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History after an append that skips keys already recorded."""
    return history.unionByName(only_new(rows, history, keys))


# ---- reading the history --------------------------------------------------------------------------

def delta(hist: DataFrame, keys: Sequence[str], counters: Sequence[str], reset_col: str | None = None,
          ts: str = "created", block: str = HISTORY_CHUNK) -> DataFrame:
    """Growth of cumulative counters since the previous snapshot of the same key.

    After a reset (a changed `reset_col`, or a smaller counter) the counter itself is the growth. The
    first snapshot of a key has no growth (NULL).
    """
    tracked = [*counters, *([reset_col] if reset_col else [])]
    rows = lag_by_block(hist.select(ts, *keys, *tracked), keys, ts, tracked, block)
    restarted = F.lit(False)
    if reset_col:
        restarted = ~F.col(reset_col).eqNullSafe(F.col(f"prev_{reset_col}"))
    out = []
    for c in counters:
        now, before = F.col(c), F.col(f"prev_{c}")
        out.append(
            F.when(before.isNull(), F.lit(None)).when(restarted | (now < before), now)
            .otherwise(now - before).alias(f"d_{c}")
        )
    return rows.select(ts, *keys, *out)


def slowest(deltas: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k statements with the highest mean execution time over the deltas, with their text."""
    keys = schemas.KEYS["queries"]
    means = deltas.groupBy(*keys).agg(
        F.sum("d_calls").alias("calls"), F.sum("d_total_exec_time").alias("total_exec_time")
    ).withColumn("mean_exec_time", F.try_divide(F.col("total_exec_time"), F.col("calls")))
    # Ranked before the texts are joined: only k rows need one.
    top = means.where(F.col("mean_exec_time").isNotNull()).orderBy(F.desc("mean_exec_time"), *keys).limit(k)
    return queries.join(F.broadcast(top), keys).select(
        *keys, "calls", "total_exec_time", "mean_exec_time", "query")


def size_growth(sizes: DataFrame, block: str = HISTORY_CHUNK) -> DataFrame:
    """Total size per table and record with its growth since the record before."""
    rows = lag_by_block(sizes.select("created", "hypertable_name", "total_size"), ["hypertable_name"],
                        "created", ["total_size"], block)
    return rows.select("created", "hypertable_name", "total_size",
                       (F.col("total_size") - F.col("prev_total_size")).alias("growth"))


def latest_connections(history: DataFrame) -> DataFrame:
    """Connections by state at each database's newest tick."""
    newest = history.groupBy("datname").agg(F.max("created").alias("created"))
    return history.join(newest, ["datname", "created"], "left_semi").select(*history.columns)


def buffered_top(buffers: DataFrame, classes: DataFrame, dbs: DataFrame, datname: str = DATABASE,
                 k: int = 10, page_bytes: int = 8192) -> DataFrame:
    """Cached bytes per relation of one database and the shared catalogs, the k largest first.

    Ordered by the number of bytes, not by its printed form. Pages are counted per file before the
    relation names are joined.
    """
    here = dbs.where(F.col("datname") == datname).select("oid").scalar()
    pages = buffers.where(F.col("reldatabase").isin(0) | (F.col("reldatabase") == here)) \
        .groupBy("relfilenode").agg(F.count("*").alias("pages"))
    return (
        pages.join(classes.select("relfilenode", "relname"), "relfilenode")
        .groupBy("relname").agg((F.sum("pages") * F.lit(page_bytes)).alias("buffered_bytes"))
        .orderBy(F.desc("buffered_bytes"), "relname").limit(k)
    )
