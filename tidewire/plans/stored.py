"""The benchmark's events as a stored measurement table with a chunk catalog, written the way a long-lived table is: in
several appends, some of them late and repeated, with a compaction between them.

Tables lie below fresh folders of the cluster's shared folder; queries that only read share one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import instant
from ..session import shared_dir
from ..sources import catalog, tables
from . import bindings as b

#: The events are spread over a month, so chunks are a day wide.
CHUNK = "1 day"
#: The first append ends here, less what comes late: every tenth event of the first hash partition.
SPLIT, COMPACTED = "2024-01-20 00:00:00", "2024-01-16 06:00:00"
#: Sensors and a time range that some queries ask for.
SENSORS = [3, 4, 17, 40, 41, 77, 90, 91, 120, 149]
TIME = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
_SHARED: dict[tuple[str, str], str] = {}


def empty(spark: SparkSession, work: str) -> str:
    name = f"tidewire_{uuid.uuid4().hex}"
    tables.create_measurements(spark, name, CHUNK, f"{work}/measurement", "bigint")
    return name


def filled(spark: SparkSession, sf: str) -> str:
    """The name of a table with all events: a first append, a compaction of the chunks that were due, then all events again with
    those that came late; the catalog's log is folded in between."""
    name = empty(spark, shared_dir(spark, "stored"))
    events = b.load(spark, sf, "events").select(F.col("ts").alias("time"), F.col("user_id").alias("sensor_id"), F.col("value").alias("measurement"),
                                                F.col("event_id").alias("arrival"))
    late = (F.col("arrival") % 10 == 0) & (F.col("sensor_id") % 4 == 0)
    tables.write_measurements(events.where((F.col("time") < instant(SPLIT)) & ~late), name, ["arrival"])
    tables.compact(spark, name, "1 day", COMPACTED)
    catalog.fold(spark, name)
    tables.write_measurements(events, name, ["arrival"])
    return name


def shared(spark: SparkSession, sf: str) -> str:
    """One such table for all queries of an application that only read it."""
    key = spark.sparkContext.applicationId, sf
    if key not in _SHARED:
        _SHARED[key] = filled(spark, sf)
    return _SHARED[key]


def rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("time").cast("timestamp_ntz").alias("time"), "sensor_id", "measurement")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog, and whether the bytes of compacted chunks are those of their files."""
    name = shared(spark, sf)
    files = tables.file_catalog(spark, name).select(*catalog.KEY, F.col("bytes").alias("found"))
    out = catalog.chunks(spark, name).join(files, catalog.KEY)
    measured = (F.col("bytes_before") > 0) & (F.col("bytes_after") == F.col("found"))
    return out.select(F.col("chunk_start").cast("timestamp_ntz").alias("chunk_start"), "hash_part", "row_count", "min_sensor_id", "max_sensor_id",
                      F.col("min_time").cast("timestamp_ntz").alias("min_time"), F.col("max_time").cast("timestamp_ntz").alias("max_time"),
                      "n_sensors", "compacted", F.when(F.col("compacted"), measured).alias("measured"))


def skipping(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with whether a scan for some sensors in a time range skips it."""
    name = shared(spark, sf)
    named = catalog.holding(spark, name, SENSORS, start=TIME[0], end=TIME[1]).withColumn("read", F.lit(True))
    return catalog.chunks(spark, name).join(named, catalog.KEY, "left").select(
        F.col("chunk_start").cast("timestamp_ntz").alias("chunk_start"), "hash_part", "row_count", F.col("read").isNull().alias("skipped"))


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of some sensors in a time range, read from the chunks that hold them."""
    return rows(catalog.scan(spark, shared(spark, sf), SENSORS, start=TIME[0], end=TIME[1]))


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a range of sensors, read from the chunks that hold one of them."""
    return rows(catalog.scan(spark, shared(spark, sf), min_sensor=20, max_sensor=23))


def retained(spark: SparkSession, sf: str) -> DataFrame:
    """The table after a retention of seven days."""
    name = filled(spark, sf)
    tables.apply_retention(spark, name, "7 days", "2024-01-30 12:00:00")
    return rows(tables.fresh(spark, name))


def deleted(spark: SparkSession, sf: str) -> DataFrame:
    """The table after the measurements of all sensors with an invalid frequency are deleted, read through the catalog."""
    name = filled(spark, sf)
    gone = b.sensor(spark, sf).where("not coalesce(sample_frequency > 0, false)").select(F.col("id").alias("sensor_id"))
    tables.delete_measurements(spark, name, gone)
    return rows(catalog.scan(spark, name))


def appended(spark: SparkSession, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """A table that holds `stored` and a reading of a year before, after `batch` has been appended twice, with another reading of that day."""
    name = empty(spark, shared_dir(spark, "appended"))
    old = spark.createDataFrame([("2023-01-05 08:00:00", -1, 1.0)], "time string, sensor_id bigint, measurement double").withColumn(
        "time", F.col("time").cast("timestamp_ntz"))
    tables.write_measurements(stored.unionByName(old), name)
    straggler = old.withColumn("measurement", F.lit(2.0)).unionByName(
        old.withColumn("sensor_id", F.lit(-2).cast("bigint"))).withColumn("arrival", F.lit(0).cast("bigint"))
    for _ in range(2):
        tables.write_measurements(batch.unionByName(straggler), name, ["arrival"])
    return rows(tables.fresh(spark, name))


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest measurement of every registered sensor, walking from the newest chunk."""
    sensors = b.sensor(spark, sf).select(F.col("id").alias("sensor_id"))
    return rows(catalog.newest(spark, shared(spark, sf), sensors))
