"""The stored chunk catalog of a measurement table: what every chunk holds, known without reading it.

The catalog is a table beside the measurement table: a log of summaries of what was appended to a chunk. A summary has the
row count, the ranges of sensor and time, and a bitmap of the sensor ids (one row for each 32 768 ids), so summaries of one
chunk merge by sums, extremes and a union of bitmaps, and an append only adds rows. Chunks are dealt to parts by a hash of the
sensor, so their sensor ranges cover nearly all ids; the bitmap is what tells chunks apart.

Order of events: a summary is written before its rows (kind ``begun``), and a ``done`` after them. A catalog may thus claim too
much for a moment, never too little, and reads that follow it lose nothing. Chunks of a version without ``done`` (a write that
broke off) are summarised anew from their rows by the next writer. ``reset`` and ``compacted`` rows replace all that was known
of a chunk before; the latter also carries the bytes of its files before and after the rewrite. `fold` rewrites the log as one
summary per chunk in a new generation.

One writer is assumed, as for the table itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timing import instant, micros
from ..session import shared_dir

#: Table property that names a table's catalog.
PROPERTY = "tidewire.catalog"
KEY = ["chunk_start", "hash_part"]
LOG = ("chunk_start timestamp, hash_part int, bucket bigint, row_count bigint, min_sensor_id bigint, max_sensor_id bigint, "
       "min_time timestamp, max_time timestamp, sensors binary, bytes_before bigint, bytes_after bigint, kind string, version bigint, "
       "generation int")
#: Ranges of partitions that a read is cut to; more are merged across the narrowest gaps.
RANGES = 256
#: A range of sensors up to this wide is looked up in the bitmaps id by id.
LISTED_SENSORS = 1024


def fresh(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now: other sessions (a stream runs in its own) may have written to it, and the
    file list a session has once read is otherwise kept."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written down: what it is read from is about to change, and a cached frame would be read from it anew."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == key).collect()
    return rows[0]["value"] if rows else None


def location(spark: SparkSession, name: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]


def ranges(frame: DataFrame, col: str, by: str | None = None, most: int = RANGES) -> list[tuple]:
    """(value of `by`, low, high) as text: ranges that cover the values of `col`, each value on its own while there are at most `most`,
    otherwise joined across the narrowest gaps. Only the ranges reach the driver."""
    group = F.col(by) if by else F.lit(0)
    values = frame.where(F.col(col).isNotNull()).select(group.alias("by"), F.col(col).alias("v")).distinct()
    order = Window.partitionBy("by").orderBy("v")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = values.select("by", micros("v").alias("at"), F.col("v").cast("string").alias("low"), F.lag("v").over(order).cast("string").alias("before"),
                         (micros("v") - F.lag(micros("v")).over(order)).alias("gap"), F.max("v").over(whole).cast("string").alias("last"))
    first = cuts.where("gap is null")
    rows = sorted(first.unionByName(cuts.where("gap is not null").orderBy(F.desc("gap"), "by", "at").limit(most)).collect(), key=lambda r: (r["by"], r["at"]))
    out = []
    for r, after in zip(rows, [*rows[1:], None][:len(rows)], strict=True):
        same = after is not None and after["by"] == r["by"]
        out.append((r["by"] if by else None, r["low"], after["before"] if same else r["last"]))
    return out


def within(found: list[tuple], col: str, kind, by: str | None = None) -> Column:
    """The condition that a row is in one of the ranges: literals, so partitions are chosen before the table is read."""
    out = F.lit(False)
    for group, low, high in found:
        low, high = (F.lit(v).cast(kind) for v in (low, high))
        one = F.col(col) == low if low is high else F.col(col).between(low, high)
        out = out | (one if by is None else (F.col(by) == group) & one)
    return out


# ---- the log ---------------------------------------------------------------------------------------

def of(spark: SparkSession, name: str) -> str | None:
    """The name of a table's catalog, None if it has none."""
    return table_property(spark, name, PROPERTY)


def create(spark: SparkSession, name: str, path: str | None = None) -> None:
    log = f"{name}_chunks"
    writer = spark.createDataFrame([], LOG).write.format("parquet").partitionBy("generation")
    (writer.option("path", path) if path else writer).saveAsTable(log)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROPERTY}' = '{log}')")


def summary(rows: DataFrame) -> DataFrame:
    """Mergeable summaries of rows that carry their chunk.

    Rows are counted by sensor first, and a chunk's sensors of one bucket meet in one task before they become a bitmap: no task
    builds bitmaps of chunks that another one has too, so as many are built as are written.
    """
    sensors = rows.groupBy(*KEY, "sensor_id").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    sensors = sensors.withColumn("bucket", F.bitmap_bucket_number(F.col("sensor_id").cast("bigint"))).repartition(*KEY, "bucket")
    return sensors.groupBy(*KEY, "bucket").agg(
        F.sum("n").alias("row_count"), F.min("sensor_id").cast("bigint").alias("min_sensor_id"), F.max("sensor_id").cast("bigint").alias("max_sensor_id"),
        F.min("first").cast("timestamp").alias("min_time"), F.max("last").cast("timestamp").alias("max_time"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("sensor_id").cast("bigint"))).alias("sensors"))


def _state(spark: SparkSession, log: str) -> tuple[int, int, list[int]]:
    """The next version, the generation in use, and the versions that are begun and not done."""
    versions = fresh(spark, log).groupBy("version").agg(F.max("generation").alias("g"), F.max(F.col("kind") == "done").alias("done"))
    row = versions.agg(F.max("version"), F.max("g"), F.collect_list(F.when(~F.col("done"), F.col("version")))).first()
    return (row[0] or 0) + 1, row[1] or 0, row[2]


def _log(rows: DataFrame, log: str, kind: str, version: int, generation: int) -> None:
    """Append rows under a kind; columns they lack are null. Few rows become one file, and computing many is not left to one task."""
    spark = rows.sparkSession
    schema = spark.table(log).schema
    given = {"kind": F.lit(kind), "version": F.lit(version), "generation": F.lit(generation)}
    full = [given.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*full).hint("rebalance").write.mode("append").insertInto(log)


def _done(spark: SparkSession, log: str, version: int, generation: int) -> None:
    _log(spark.range(1).select(F.lit(None).alias("none")), log, "done", version, generation)


def record(rows: DataFrame, name: str, append) -> None:
    """Append rows to the table by `append(rows)`, told to the catalog before and after."""
    spark = rows.sparkSession
    log = of(spark, name)
    if log is None:
        append(rows)
        return
    version, generation = repair(spark, name)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _log(summary(rows), log, "begun", version, generation)
        append(rows)
        _done(spark, log, version, generation)
    finally:
        rows.unpersist()


def opened(spark: SparkSession, name: str, chunks: DataFrame) -> None:
    """Tell the catalog that the rows of these chunks are about to change; `repair` afterwards summarises them anew."""
    log = of(spark, name)
    version, generation, _ = _state(spark, log)
    _log(chunks.select(*KEY).distinct(), log, "open", version, generation)


def repair(spark: SparkSession, name: str) -> tuple[int, int]:
    """Summarise the chunks of writes that broke off from their rows; returns the next version and the generation in use."""
    log = of(spark, name)
    version, generation, broken = _state(spark, log)
    if not broken:
        return version, generation
    chunks = staged(fresh(spark, log).where(F.col("version").isin(broken) & F.col("chunk_start").isNotNull()).select(*KEY).distinct(), "broken")
    rows = fresh(spark, name)
    found = rows.where(within(ranges(chunks, "chunk_start", "hash_part"), "chunk_start", rows.schema["chunk_start"].dataType, "hash_part")) \
        .join(chunks, KEY, "left_semi")
    _log(chunks, log, "reset", version, generation)
    _log(summary(found), log, "begun", version, generation)
    for v in [*broken, version]:
        _done(spark, log, v, generation)
    return version + 1, generation


def forget(spark: SparkSession, name: str, there: DataFrame) -> None:
    """Take chunks that are no longer `there` (text values, from the table's partitions) off the catalog."""
    log = of(spark, name)
    version, generation, _ = _state(spark, log)
    here = there.select(F.col("chunk_start").cast("timestamp"), F.col("hash_part").cast("int"))
    gone = staged(chunks(spark, name).select(*KEY).join(here, KEY, "left_anti"), "gone")
    if not gone.isEmpty():
        _log(gone, log, "reset", version, generation)
        _done(spark, log, version, generation)


def rewritten(spark: SparkSession, name: str, sizes: DataFrame) -> None:
    """Chunks have been compacted: (chunk_start, hash_part, bytes_before, bytes_after). Their rows are the same, so is their summary."""
    log = of(spark, name)
    version, generation, _ = _state(spark, log)
    same = staged(_live(spark, log).join(sizes.select(*KEY), KEY, "left_semi").groupBy(*KEY, "bucket").agg(*_merged()), "same")
    _log(same, log, "begun", version, generation)
    _log(sizes, log, "compacted", version, generation)
    _done(spark, log, version, generation)


def fold(spark: SparkSession, name: str) -> None:
    """The log as one summary per chunk and bucket, in a generation of its own; older generations go. Interrupted in between, both are
    there and mean the same."""
    version, generation = repair(spark, name)
    log = of(spark, name)
    merged = staged(_live(spark, log).groupBy(*KEY, "bucket").agg(*_merged()), "merged")
    marks = staged(chunks(spark, name).select(*KEY, "bytes_before", "bytes_after", "compacted"), "marks")
    for kind in ("reset", "compacted"):
        _log(marks.where(F.col("compacted") == (kind == "compacted")), log, kind, version, generation + 1)
    _log(merged, log, "begun", version, generation + 1)
    _done(spark, log, version, generation + 1)
    for old in fresh(spark, log).where(F.col("generation") <= generation).select("generation").distinct().collect():
        spark.sql(f"ALTER TABLE {log} DROP IF EXISTS PARTITION (generation = {old[0]})")


def _merged() -> list[Column]:
    return [F.sum("row_count").alias("row_count"), F.min("min_sensor_id").alias("min_sensor_id"), F.max("max_sensor_id").alias("max_sensor_id"),
            F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.bitmap_or_agg("sensors").alias("sensors")]


def _marks(log: DataFrame) -> DataFrame:
    """The latest replacement of each chunk."""
    last = log.where(F.col("kind").isin("reset", "compacted")).groupBy(*KEY).agg(
        F.max(F.struct("version", "kind", "bytes_before", "bytes_after")).alias("mark"))
    return last.select(*KEY, "mark.*").withColumnRenamed("version", "since").withColumnRenamed("kind", "how")


def _live(spark: SparkSession, log: str) -> DataFrame:
    """The summaries that count."""
    rows = fresh(spark, log)
    own = rows.where("kind = 'begun'").drop("kind", "generation", "bytes_before", "bytes_after")
    return own.join(_marks(rows), KEY, "left").where(F.col("since").isNull() | (F.col("version") >= F.col("since")))


# ---- reading ---------------------------------------------------------------------------------------

def chunks(spark: SparkSession, name: str) -> DataFrame:
    """One row per chunk with rows: counts and ranges, n_sensors, whether it is compacted (rewritten, and nothing appended since), and its bytes before and after."""
    whole = F.max("how") == "compacted"
    parts = _live(spark, of(spark, name)).groupBy(*KEY, "bucket").agg(
        *_merged(), F.max("since").alias("since"), F.max("version").alias("version"), F.max("how").alias("how"),
        F.max("bytes_before").alias("bytes_before"), F.max("bytes_after").alias("bytes_after"))
    return parts.groupBy(*KEY).agg(
        F.sum("row_count").alias("row_count"), F.min("min_sensor_id").alias("min_sensor_id"), F.max("max_sensor_id").alias("max_sensor_id"),
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.sum(F.bitmap_count("sensors")).alias("n_sensors"),
        F.coalesce(whole & (F.max("version") == F.max("since")), F.lit(False)).alias("compacted"),
        F.max("bytes_before").alias("bytes_before"), F.max("bytes_after").alias("bytes_after"))


def holding(spark: SparkSession, name: str, sensors: Sequence[int] | None = None, min_sensor: int | None = None,
            max_sensor: int | None = None, start=None, end=None) -> DataFrame:
    """(chunk_start, hash_part) of the chunks that may hold rows of the sensors, listed or from a range, in [start, end).

    Listed sensors, and the ids of a narrow range, are looked up in the bitmaps: a chunk is named if it holds one of them.
    """
    found = _live(spark, of(spark, name))
    if start is not None:
        found = found.where(F.col("max_time") >= instant(start))
    if end is not None:
        found = found.where(F.col("min_time") < instant(end))
    if min_sensor is not None:
        found = found.where(F.col("max_sensor_id") >= min_sensor)
    if max_sensor is not None:
        found = found.where(F.col("min_sensor_id") <= max_sensor)
    if sensors is None and min_sensor is not None and max_sensor is not None and max_sensor - min_sensor < LISTED_SENSORS:
        sensors = range(min_sensor, max_sensor + 1)
    if sensors is not None:
        found = _with_any(found, spark.createDataFrame([(int(i),) for i in sensors], "wanted bigint"))
    return found.select(*KEY).distinct()


def _with_any(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Summaries whose bitmap has the bit of one of the ids (`wanted`)."""
    ids = wanted.distinct().select(F.bitmap_bucket_number("wanted").alias("bucket"), F.bitmap_bit_position("wanted").alias("bit"))
    byte = F.conv(F.hex(F.substr("sensors", (F.expr("bit div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int"))
    return found.join(ids, "bucket").where(bit.bitwiseAND(F.lit(1)) == 1)


def scan(spark: SparkSession, name: str, sensors: Sequence[int] | None = None, min_sensor: int | None = None,
         max_sensor: int | None = None, start=None, end=None) -> DataFrame:
    """The rows of the sensors in [start, end), read from the chunks the catalog names and no others (above `RANGES` ranges of chunks also from
    chunks in the narrowest gaps between them). The table is read once, by literal partition filters."""
    rows = fresh(spark, name)
    named = ranges(holding(spark, name, sensors, min_sensor, max_sensor, start, end), "chunk_start", "hash_part")
    out = rows.where(within(named, "chunk_start", rows.schema["chunk_start"].dataType, "hash_part"))
    if sensors is not None:
        out = out.where(F.col("sensor_id").isin([int(i) for i in sensors]))
    if min_sensor is not None:
        out = out.where(F.col("sensor_id") >= min_sensor)
    if max_sensor is not None:
        out = out.where(F.col("sensor_id") <= max_sensor)
    if start is not None:
        out = out.where(F.col("time") >= instant(start))
    return out if end is None else out.where(F.col("time") < instant(end))


def newest(spark: SparkSession, name: str, sensors: DataFrame, step: int = 1) -> DataFrame:
    """The newest row of each sensor (frame with `sensor_id`) that has one, from the newest chunks on.

    A round reads the `step` newest chunk starts that hold a sensor still looked for, by the catalog, and the next round twice as
    many; it ends when all are found or no chunk holds any of the others, so silent sensors cost no reads.
    """
    rows = fresh(spark, name)
    kind = rows.schema["chunk_start"].dataType
    left = staged(sensors.select(F.col("sensor_id").cast("bigint").alias("wanted")).where("wanted is not null").distinct(), "wanted")
    known, before, found = staged(_live(spark, of(spark, name)), "catalog"), None, rows.limit(0)
    while True:
        older = known if before is None else known.where(F.col("chunk_start") < F.lit(before))
        named = _with_any(older, left).select(*KEY).distinct()
        starts = [r[0] for r in named.select("chunk_start").distinct().orderBy(F.desc("chunk_start")).limit(step).collect()]
        if not starts:
            return found
        before, step = starts[-1], 2 * step
        named = named.where(F.col("chunk_start") >= F.lit(before))
        here = rows.where(within(ranges(named, "chunk_start", "hash_part"), "chunk_start", kind, "hash_part")).join(
            left.select(F.col("wanted").alias("sensor_id")), "sensor_id", "left_semi")
        some = [F.max_by(c, "time").alias(c) for c in rows.columns if c != "sensor_id"]
        latest = staged(here.groupBy("sensor_id").agg(*some).select(*rows.columns), "newest")
        found = found.unionByName(latest)
        left = staged(left.join(latest.select(F.col("sensor_id").cast("bigint").alias("wanted")), "wanted", "left_anti"), "wanted")
