"""Chunks, retention and compaction as frame operations; `sources.tables` applies them to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import age_minutes, bucket, instant, micros, shift, width_us

# Declared policies.
MEASUREMENT_CHUNK = "5 minutes"
MEASUREMENT_HASH_PARTS = 4
MEASUREMENT_RETENTION = "30 minutes"
MEASUREMENT_COMPACT_AFTER = "15 minutes"
HISTORY_CHUNK = "1 day"
HISTORY_RETENTION = "7 days"
HISTORY_COMPACT_AFTER = "1 hour"


def with_chunk(df: DataFrame, ts: str = "time", width: str = MEASUREMENT_CHUNK, key: str | None = "sensor_id",
               n: int = MEASUREMENT_HASH_PARTS) -> DataFrame:
    """Adds the partition columns: chunk_start, and hash_part when a key is given."""
    df = df.withColumn("chunk_start", bucket(ts, width))
    return df if key is None else df.withColumn("hash_part", F.pmod(F.col(key), F.lit(n)).cast("int"))


def of_sensors(df: DataFrame, ids: Sequence[int], key: str = "sensor_id", n: int = MEASUREMENT_HASH_PARTS
               ) -> DataFrame:
    """Rows of the listed sensors, read from their hash partitions only."""
    return df.where(F.col(key).isin(list(ids)) & F.col("hash_part").isin(sorted({i % n for i in ids})))


def expired(chunk_start: Column | str, width: str, keep: str, as_of) -> Column:
    """A chunk expires as a whole, once its end is `keep` old."""
    return micros(chunk_start) + F.lit(width_us(width) + width_us(keep)) <= micros(instant(as_of))


def retained(df: DataFrame, keep: str, as_of, ts: str = "time", width: str = MEASUREMENT_CHUNK) -> DataFrame:
    """Rows that survive retention: those of chunks not yet expired.

    Written as a lower bound on the time itself, which reaches the scan.
    """
    cut = bucket(shift(instant(as_of), -width_us(keep)), width)
    return df.where(F.col(ts) >= cut)


def chunk_catalog(df: DataFrame, as_of, compact_after: str = MEASUREMENT_COMPACT_AFTER,
                  width: str = MEASUREMENT_CHUNK, ts: str = "time") -> DataFrame:
    """One row per chunk: bounds, row count, sensor and time ranges, age, and whether it is due for
    (or past) compaction. `df` carries the columns of `with_chunk`."""
    end = shift("chunk_start", width_us(width))
    age = age_minutes("chunk_end", instant(as_of))
    return (
        df.groupBy("chunk_start", "hash_part").agg(
            F.count("*").alias("row_count"),
            F.min("sensor_id").alias("min_sensor_id"), F.max("sensor_id").alias("max_sensor_id"),
            F.min(ts).alias("min_time"), F.max(ts).alias("max_time"),
        )
        .withColumn("chunk_end", end)
        .withColumn("age_minutes", age)
        .withColumn("compacted", F.col("age_minutes") >= F.lit(width_us(compact_after) / 60e6))
    )


def chunk_distribution(catalog: DataFrame) -> DataFrame:
    """Chunk count, compacted share and row spread per chunk start."""
    return catalog.groupBy("chunk_start").agg(
        F.count("*").alias("chunks"), F.count_if("compacted").alias("compacted_chunks"),
        F.sum("row_count").alias("row_count"), F.max("row_count").alias("largest_chunk"),
    )


def newest_chunks(catalog: DataFrame, k: int = 20) -> DataFrame:
    return catalog.orderBy(F.desc("chunk_start"), "hash_part").limit(k)


def skipping(catalog: DataFrame, min_sensor: int, max_sensor: int, start, end) -> DataFrame:
    """The catalog with ``skipped``: whether the ranges of a chunk exclude the predicate."""
    overlaps = (
        (F.col("max_sensor_id") >= min_sensor) & (F.col("min_sensor_id") <= max_sensor)
        & (F.col("max_time") >= instant(start)) & (F.col("min_time") < instant(end))
    )
    return catalog.withColumn("skipped", ~overlaps)


def prune(df: DataFrame, catalog: DataFrame, min_sensor: int, max_sensor: int, start, end) -> DataFrame:
    """Rows matching a sensor and time range, read only from chunks whose ranges allow a match."""
    chunks = skipping(catalog, min_sensor, max_sensor, start, end).where(~F.col("skipped"))
    return (
        df.where(F.col("sensor_id").between(min_sensor, max_sensor))
        .where((F.col("time") >= instant(start)) & (F.col("time") < instant(end)))
        .join(chunks.select("chunk_start", "hash_part"), ["chunk_start", "hash_part"], "left_semi")
    )


def compacted_layout(df: DataFrame, ts: str = "time", key: str = "sensor_id") -> DataFrame:
    """Rows laid out for columnar storage: by chunk, then key, newest first.

    Range partitioning on the full sort order cuts a key that dominates its chunk across several tasks,
    and gives every file a narrow key and time range for row-group skipping.
    """
    order = [F.col("chunk_start"), F.col("hash_part"), F.col(key), F.col(ts).desc()]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def compression_ratio(catalog: DataFrame) -> DataFrame:
    """Bytes before and after compaction and the saved percentage, per table."""
    before, after = F.sum("bytes_before"), F.sum("bytes_after")
    return catalog.where("compacted").groupBy("table_name").agg(
        F.count("*").alias("chunks"), before.alias("bytes_before"), after.alias("bytes_after"),
        F.try_divide(before.cast("double"), after.cast("double")).alias("ratio"),
    )
