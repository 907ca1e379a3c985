"""Partitioned catalog tables: conflict-aware appends, deletes, retention and compaction.

Tables are catalog tables rather than bare paths because retention and deletes drop partitions. One
writer per table is assumed, as in the telemetry pipeline; readers see whole committed appends. The ingest can run
maintenance between its micro-batches (`streaming.ingest.start`), so that it stays the only writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import width_us
from ..operators import ingest, lifecycle
from ..session import configure, shared_dir
from . import catalog
from .catalog import fresh

MEASUREMENT_PARTITIONS = ["chunk_start", "hash_part"]

#: Table property that holds the width of the chunks a table was written with.
CHUNK_PROPERTY = "tidewire.chunk"


def create(df: DataFrame, name: str, partitions: Sequence[str] = ()) -> None:
    """Create the table from a frame (possibly empty)."""
    writer = df.write.format("parquet")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.saveAsTable(name)


def create_measurements(spark: SparkSession, name: str, chunk: str = lifecycle.MEASUREMENT_CHUNK, path: str | None = None,
                        sensor_type: str = "int", chunk_catalog: bool = True) -> None:
    """A measurement table whose chunks have the given width, which is kept as a table property, with a chunk catalog beside it."""
    empty = spark.createDataFrame([], f"time timestamp, sensor_id {sensor_type}, measurement double")
    writer = lifecycle.with_chunk(empty, width=chunk).write.format("parquet").partitionBy(*MEASUREMENT_PARTITIONS)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{CHUNK_PROPERTY}' = '{chunk}')")
    if chunk_catalog:
        catalog.create(spark, name, path and f"{path}_chunks")


def chunk_width(spark: SparkSession, name: str) -> str | None:
    """The width of a table's chunks, None if the table does not say: readers then prune by the upper bound only."""
    return catalog.table_property(spark, name, CHUNK_PROPERTY)


def _width(spark: SparkSession, name: str, given: str | None) -> str:
    """The width the table says, which a given one must agree with; only a table that does not say takes the given one."""
    own = chunk_width(spark, name)
    if own is None and given is None:
        raise ValueError(f"{name} does not say how wide its chunks are")
    if own and given and width_us(own) != width_us(given):
        raise ValueError(f"{name} has chunks of {own}, not of {given}")
    return own or given


class ConcurrentWriteError(RuntimeError):
    """Another writer changed what is being rewritten."""


def touched(batch: DataFrame, target: DataFrame, col: str) -> DataFrame:
    """The target's rows in the partitions the batch has, chosen by literals: a straggler adds its own partition, not all between."""
    return target.where(catalog.within(catalog.ranges(batch, col), col, target.schema[col].dataType))


def write(batch: DataFrame, name: str, keys: Sequence[str], arrival: Sequence[str] = (),
          on_conflict: str = "ignore", partitions: Sequence[str] = ()) -> None:
    """Append a batch under a unique key.

    ``ignore``: first arrival wins, rows whose key is stored are skipped, so writing a batch again adds
    nothing. ``error``: raise `DuplicateKeyError` and write nothing when any key repeats.

    The batch is read for its partition values and again for the append; a caller whose batch is costly
    to compute persists it.
    """
    spark = batch.sparkSession
    target = fresh(spark, name)
    columns = target.columns
    if partitions:
        target = touched(batch, target, partitions[0])
    full_keys = [*keys, *partitions]
    if on_conflict == "error":
        clash = ingest.duplicate_keys(batch, target, full_keys).first()
        if clash is not None:
            raise ingest.DuplicateKeyError(str(clash.asDict()))
    new = ingest.resolve(batch, target, full_keys, arrival, on_conflict).select(*columns)
    catalog.record(new, name, lambda rows: append(rows, name, partitions))


def append(rows: DataFrame, name: str, partitions: Sequence[str] = ()) -> None:
    """Plain append; rows are gathered by partition, and a partition too large for a task is split."""
    if partitions:
        rows = rows.hint("rebalance", *partitions)
    rows.write.mode("append").insertInto(name)


def write_measurements(batch: DataFrame, name: str, arrival: Sequence[str] = (), on_conflict: str = "ignore",
                       chunk: str | None = None) -> None:
    """Append (time, sensor_id, measurement) records under the key (sensor_id, time). Chunks have the width the table says; a table
    that does not say takes `chunk` and says it from then on, so a record always belongs to one chunk."""
    spark = batch.sparkSession
    width = _width(spark, name, chunk)
    if chunk_width(spark, name) is None:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{CHUNK_PROPERTY}' = '{width}')")
    write(lifecycle.with_chunk(batch, width=width), name, ["sensor_id", "time"], arrival, on_conflict, MEASUREMENT_PARTITIONS)


def write_history(rows: DataFrame, name: str, keys: Sequence[str], on_conflict: str = "ignore") -> None:
    """Append snapshot rows to a history table partitioned by the day of ``created``."""
    day = rows.withColumn("created_day", F.to_date("created"))
    write(day, name, keys, [], on_conflict, ["created_day"])


def holds_any(rows: DataFrame, name: str, keys: Sequence[str]) -> bool:
    """Whether a history table has the key of one of the rows already."""
    day = rows.withColumn("created_day", F.to_date("created"))
    target = touched(day, fresh(rows.sparkSession, name), "created_day")
    return not ingest.existing(day, target, [*keys, "created_day"]).isEmpty()


def create_history(df: DataFrame, name: str) -> None:
    create(df.withColumn("created_day", F.to_date("created")).limit(0), name, ["created_day"])


# ---- partitions -----------------------------------------------------------------------------------

def partitions(spark: SparkSession, name: str, cols: Sequence[str]) -> DataFrame:
    """Values of the partition columns as text, from the catalog alone: no data file is opened."""
    spec = F.str_to_map("partition", F.lit("/"), F.lit("="))
    listed = spark.sql(f"SHOW PARTITIONS {name}").select(spec.alias("spec"))
    return listed.select(*[F.replace(F.col("spec")[c], F.lit("%3A"), F.lit(":")).alias(c) for c in cols])


def _texts(df: DataFrame, col: str) -> list[str]:
    """Partition values as text in the session's zone, which SQL literals use too."""
    return sorted(r[0] for r in df.select(F.col(col).cast("string")).collect())


def drop_partitions(spark: SparkSession, name: str, specs: DataFrame) -> int:
    """Drop the listed partitions, data included. A partition must be named in full to be found."""
    rows = [", ".join(f"{c} = '{v}'" for c, v in r.asDict().items()) for r in specs.collect()]
    if rows:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION ({r})" for r in rows))
    return len(rows)


def drop_before(spark: SparkSession, name: str, col: str, number: int) -> int:
    """Drop the partitions whose number is below the given one."""
    return drop_partitions(spark, name, partitions(spark, name, [col]).where(F.col(col).cast("bigint") < number))


def apply_retention(spark: SparkSession, name: str, keep: str, as_of, cols: Sequence[str] = MEASUREMENT_PARTITIONS,
                    width: str | None = None) -> int:
    """Drop the partitions whose chunk ended at least `keep` before `as_of`; returns how many.

    The first of `cols` is the chunk's start; chunks are as wide as the table says, `width` is for tables that do not.
    Only partition names are handled, which retention itself keeps few.
    """
    start, width = F.col(cols[0]).cast("timestamp"), _width(spark, name, width)
    dropped = drop_partitions(spark, name, partitions(spark, name, cols).where(lifecycle.expired(start, width, keep, as_of)))
    if catalog.of(spark, name):
        catalog.forget(spark, name, partitions(spark, name, cols))
    return dropped


def compact(spark: SparkSession, name: str, after: str, as_of, done: Sequence[str] = (), width: str | None = None) -> list[str]:
    """Rewrite the chunks that ended at least `after` ago in columnar order; returns their starts.

    Chunks that the table's catalog knows as compacted stay as they are, and so do those that `done` names (for tables without
    a catalog). The catalog learns the bytes of the files before and after.
    """
    due = partitions(spark, name, MEASUREMENT_PARTITIONS).where(
        lifecycle.expired(F.col("chunk_start").cast("timestamp"), _width(spark, name, width), after, as_of))
    due = due.select(F.col("chunk_start").cast("timestamp"), F.col("hash_part").cast("int")).where(
        ~F.col("chunk_start").cast("string").isin(list(done)))
    listed = catalog.of(spark, name)
    if listed:
        catalog.repair(spark, name)
        due = due.join(catalog.chunks(spark, name).where("compacted").select(*MEASUREMENT_PARTITIONS), MEASUREMENT_PARTITIONS, "left_anti")
    due = catalog.staged(due, "due")
    starts = sorted(set(_texts(due, "chunk_start")))
    if starts:
        rows = fresh(spark, name)
        named = catalog.ranges(due, "chunk_start", "hash_part")
        own = rows.where(catalog.within(named, "chunk_start", rows.schema["chunk_start"].dataType, "hash_part")).join(due, MEASUREMENT_PARTITIONS, "left_semi")
        before = catalog.staged(file_catalog(spark, name, due), "bytes")
        _rewrite(own.select(*rows.columns), name, due)
        if listed:
            sizes = before.withColumnRenamed("bytes", "bytes_before").drop("files").join(
                file_catalog(spark, name, due).withColumnRenamed("bytes", "bytes_after").drop("files"), MEASUREMENT_PARTITIONS)
            catalog.rewritten(spark, name, sizes)
    return starts


def _rewrite(rows: DataFrame, name: str, chunks: DataFrame | None = None) -> None:
    """Overwrite exactly the partitions the rows belong to, in columnar order.

    The rows are staged in the shared folder first: the partitions being replaced are also the input,
    and a task repeated after a lost executor must still find it. If files have joined the `chunks` meanwhile, nothing is overwritten.
    """
    spark = configure(rows.sparkSession)
    staged = shared_dir(spark, "rewrite")
    seen = _files(spark, name, chunks) if chunks is not None else None
    rows.write.parquet(staged)
    back = lifecycle.compacted_layout(spark.read.schema(rows.schema).parquet(staged))
    if seen is not None and _files(spark, name, chunks) != seen:
        raise ConcurrentWriteError(f"{name} was written to while it was being compacted")
    back.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


def _files(spark: SparkSession, name: str, chunks: DataFrame) -> int:
    """A digest of the names of the chunks' files."""
    return _listing(spark, name, chunks).agg(F.sum(F.xxhash64("path").cast("decimal(38,0)"))).first()[0]


def delete_measurements(spark: SparkSession, name: str, sensors: DataFrame) -> None:
    """Delete the measurements of the given sensors (frame with ``sensor_id``).

    Partitions that hold such rows are rewritten without them, and dropped where nothing remains: a
    dynamic overwrite leaves a partition alone that receives no rows.
    """
    doomed = sensors.select("sensor_id").distinct()
    # At most as many values as there are hash partitions.
    parts = doomed.select(F.pmod("sensor_id", F.lit(lifecycle.MEASUREMENT_HASH_PARTS)).alias("p")).distinct().collect()
    m = fresh(spark, name).where(F.col("hash_part").isin([r.p for r in parts]))
    hit = m.join(doomed, "sensor_id", "left_semi").select(*MEASUREMENT_PARTITIONS).distinct()
    kept = m.join(hit, MEASUREMENT_PARTITIONS, "left_semi").join(doomed, "sensor_id", "left_anti")
    left = kept.select(*MEASUREMENT_PARTITIONS).distinct()
    empty = hit.join(left, MEASUREMENT_PARTITIONS, "left_anti") \
        .select(*[F.col(c).cast("string") for c in MEASUREMENT_PARTITIONS])
    # Written down before the rewrite changes what it is derived from.
    dropped = spark.createDataFrame(empty.collect(), empty.schema)
    listed = catalog.of(spark, name)
    if listed:
        catalog.opened(spark, name, hit)
    _rewrite(kept.select(*m.columns), name)
    drop_partitions(spark, name, dropped)
    if listed:
        catalog.repair(spark, name)


def table_sizes(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """File bytes per table, from the file listing alone. `tables` maps a table name to its folder."""
    parts = None
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        one = files.agg(F.sum("length").alias("table_bytes")).select(F.lit(name).alias("hypertable_name"), "*")
        parts = one if parts is None else parts.unionByName(one)
    zero = F.lit(0).cast("bigint")
    return parts.select(
        "hypertable_name", "table_bytes", zero.alias("index_bytes"), zero.alias("toast_bytes"),
        F.col("table_bytes").alias("total_bytes"), F.lit(None).cast("string").alias("node_name"),
    )


def _listing(spark: SparkSession, name: str, chunks: DataFrame | None = None) -> DataFrame:
    """The files of a table (path, length, chunk_start, hash_part), of the given chunks only; no file is opened."""
    where, specs = catalog.location(spark, name), spark.sql(f"SHOW PARTITIONS {name}")
    if chunks is not None:
        spec = F.str_to_map("partition", F.lit("/"), F.lit("="))
        keys = specs.select("partition", F.url_decode(spec["chunk_start"]).cast("timestamp").alias("chunk_start"), spec["hash_part"].cast("int").alias("hash_part"))
        specs = keys.join(chunks.select(*MEASUREMENT_PARTITIONS), MEASUREMENT_PARTITIONS, "left_semi")
    folders = [f"{where}/{r['partition']}" for r in specs.select("partition").collect()]
    if not folders:
        return spark.createDataFrame([], "path string, length bigint, chunk_start timestamp, hash_part int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    part = F.regexp_extract("path", "chunk_start=([^/]+)/hash_part=([^/]+)/", 1)
    return files.select("path", "length", F.url_decode(F.url_decode(part)).cast("timestamp").alias("chunk_start"),
                        F.regexp_extract("path", "/hash_part=([^/]+)/", 1).cast("int").alias("hash_part"))


def file_catalog(spark: SparkSession, name: str, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks of a table with their file count and bytes, from the file listing alone."""
    return _listing(spark, name, chunks).groupBy(*MEASUREMENT_PARTITIONS).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
