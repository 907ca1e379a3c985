"""Batch-side ingest: identity resolution, conflict handling and per-batch statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import instant, seconds_between


def match_sensors(readings: DataFrame, sensor: DataFrame) -> DataFrame:
    """Readings with their ``sensor_id``, NULL for an unknown serial.

    The registry is joined without a hint: it is broadcast while its size allows it, otherwise both sides
    are sorted and a dominating serial is split.
    """
    known = sensor.select(F.col("id").alias("sensor_id"), "serial_number")
    return readings.join(known, "serial_number", "left")


def mark_rejected(matched: DataFrame, mode: str = "strict", batch: str = "batch_id") -> DataFrame:
    """Adds whether a reading is ``rejected``.

    ``strict`` rejects every reading of a message that names an unknown serial; ``quarantine`` rejects
    only the readings with an unknown serial. Only the ids of rejected messages, usually few, are gathered and
    joined; the readings are not sorted by message.
    """
    missing = F.col("sensor_id").isNull()
    if mode == "quarantine":
        return matched.withColumn("rejected", missing)
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    bad = matched.where(missing).select(F.col(batch).alias("__batch")).distinct().withColumn("__bad", F.lit(True))
    return matched.join(bad, F.col(batch).eqNullSafe(F.col("__batch")), "left").select(
        *matched.columns, F.coalesce("__bad", F.lit(False)).alias("rejected"))


def enrich(readings: DataFrame, sensor: DataFrame, mode: str = "strict", batch: str = "batch_id"
           ) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rejected rows), see `mark_rejected`."""
    return split_rejected(mark_rejected(match_sensors(readings, sensor), mode, batch))


def split_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(~F.col("rejected")).drop("rejected"), rows.where("rejected").drop("rejected")


def to_records(rows: DataFrame, arrival: Sequence[str] = ()) -> DataFrame:
    """Readings as table records; everything the table does not store is dropped."""
    return rows.select("time", "sensor_id", "measurement", *arrival)


def first_by_arrival(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The row that arrived first per key, without the arrival columns.

    An aggregate rather than a ranking window: copies are folded before the shuffle, so a key that was
    sent very often costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in arrival]
    if not rest:
        return df.select(*keys).distinct()
    if not arrival:
        # Without an arrival order copies are taken to be equal, as the rows of one snapshot are.
        return df.dropDuplicates(list(keys))
    order = F.col(arrival[0]) if len(arrival) == 1 else F.struct(*arrival)
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest]).select(
        *[c for c in df.columns if c not in arrival])


def only_new(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not hold."""
    return batch.join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)


def existing(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target already holds."""
    return batch.join(target.select(*keys), list(keys), "left_semi").select(*batch.columns)


class DuplicateKeyError(ValueError):
    """A write in ``error`` mode met a key that is already there."""


def resolve(batch: DataFrame, target: DataFrame, keys: Sequence[str], arrival: Sequence[str],
            on_conflict: str = "ignore") -> DataFrame:
    """The rows a write would append.

    ``ignore``: first arrival per key, minus the keys the target holds. ``error``: the batch as it is,
    see `duplicate_keys` for the check.
    """
    if on_conflict == "ignore":
        return only_new(first_by_arrival(batch, keys, arrival), target, keys)
    if on_conflict == "error":
        return batch.drop(*arrival)
    raise ValueError(f"unknown on_conflict {on_conflict!r}")


def duplicate_keys(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur twice in the batch or are already in the target, with both counts."""
    n = batch.groupBy(*keys).agg(F.count("*").alias("in_batch"))
    held = existing(n, target, keys).withColumn("in_target", F.lit(True))
    twice = only_new(n.where("in_batch > 1"), target, keys).withColumn("in_target", F.lit(False))
    return held.unionByName(twice)


def batch_stats(readings: DataFrame, batch: str = "batch_id", by: Sequence[str] = ("serial_number",)) -> DataFrame:
    """Readings and oldest time per (message, sensor): the oldest gives the worst latency of a message."""
    return readings.groupBy(batch, *by).agg(F.count("*").alias("n"), F.min("time").alias("oldest_time"))


def end_to_end_seconds(stats: DataFrame, completed: Column) -> DataFrame:
    return stats.withColumn("latency_seconds", seconds_between("oldest_time", completed))


def late_flag(rows: DataFrame, as_of, retention_us: int) -> DataFrame:
    """Any time is accepted; rows that retention will remove anyway are marked."""
    age = seconds_between("time", instant(as_of))
    return rows.withColumn("late", age > F.lit(retention_us / 1e6))
