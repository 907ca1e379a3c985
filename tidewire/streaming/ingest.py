"""Continuous ingest: measurement messages to the measurement table."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode, ingest
from ..operators.lifecycle import MEASUREMENT_CHUNK
from ..session import ROCKSDB_PROVIDER, configure
from ..sources import epochs, tables


#: Columns of the statistics table.
STATS = ("batch_id string, serial_number string, status string, n bigint, oldest_time timestamp, "
         "completed timestamp, seconds double, epoch bigint")


class RejectedBatchError(RuntimeError):
    """A micro-batch held messages that may not be skipped."""


def drop_resent(readings: DataFrame, within: str) -> DataFrame:
    """In-stream pre-filter for copies that arrive close together; the table write stays the exact check.

    A reading's key is kept for `within` after its first arrival, by the clock of the micro-batches: the state holds the
    keys of that time, whatever times the readings carry. No reading is late, a year old or not; a copy that
    arrives after `within` passes. A repeated micro-batch has the clock of its first attempt.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    arrived = readings.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", within)
    return arrived.dropDuplicatesWithinWatermark(["serial_number", "time"]).drop("__arrived")


def start(messages: DataFrame, sensor_table: str, target: str, checkpoint: str, rejected: str | None = None,
          malformed: str | None = None, stats: str | None = None, mode: str = "strict", on_bad: str = "quarantine",
          arrival: Sequence[str] = ("arrival", "pos"), batch: str = "batch_id", chunk: str = MEASUREMENT_CHUNK,
          trigger: dict | None = None, retry: str | None = None, attempts: int = 5,
          maintenance: Callable[[SparkSession], object] | None = None, maintain_every: int = 60) -> StreamingQuery:
    """Start the query. `messages` has (batch_id, arrival, value).

    The registry is read anew for every micro-batch, so a sensor is known as soon as it is registered.
    Rejected readings go to the table `rejected` and undecodable messages to the table `malformed`, which
    ``on_bad='quarantine'`` requires: nothing is dropped. With ``on_bad='fail'`` either fails the micro-batch instead,
    and Spark repeats it from the checkpoint. A repeated or replayed micro-batch adds nothing to the target, because
    its keys are stored already. Chunks have the width the target was created with, or `chunk` if it does not say.

    The table `stats` receives a row per (message, sensor) with the reading count, oldest time, outcome
    and completion time: the source of the ingest's counters and latency histograms. `stats`, `rejected` and `malformed`
    are tables of `sources.epochs`: read them with its `read`.

    With a table `retry` a message that is rejected is tried again with the next micro-batch, `attempts` times in all, before its
    readings go to `rejected`: readings may so arrive before their sensor is registered. Messages wait whole, with the number of
    failed attempts, in the partition of the micro-batch that they failed in; the table belongs to the checkpoint. Each attempt
    counts in `stats`.

    `maintenance(spark)` is called after every `maintain_every` micro-batches, between the writes, so that retention and
    compaction never meet another writer.
    """
    if on_bad not in ("quarantine", "fail"):
        raise ValueError(f"unknown on_bad {on_bad!r}")
    if on_bad == "quarantine" and (rejected is None or malformed is None):
        raise ValueError("quarantine needs the tables `rejected` and `malformed`")

    def handle(micro: DataFrame, epoch: int) -> None:
        spark = micro.sparkSession
        began = time.monotonic()
        if retry is not None:
            micro = micro.withColumn("attempt", F.lit(0))
            if spark.catalog.tableExists(retry):
                waiting = tables.fresh(spark, retry).where(F.col("epoch") == epoch - 1)
                micro = micro.unionByName(waiting.select(*micro.columns))
        readings, broken = decode.measurements(micro)
        # Parsed and matched once, then read by every write below.
        matched = ingest.match_sensors(readings, tables.fresh(spark, sensor_table))
        matched = matched.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = ingest.mark_rejected(matched, mode, batch)
            good, bad = ingest.split_rejected(rows)
            if on_bad == "fail" and (bad.select(F.lit(1)).first() or broken.select(F.lit(1)).first()):
                raise RejectedBatchError(f"micro-batch {epoch}")
            if retry is not None:
                ids = bad.select(F.col(batch).alias("__batch")).distinct()
                failed = micro.join(ids, F.col(batch).eqNullSafe(F.col("__batch")), "left_semi").withColumn("attempt", F.col("attempt") + 1)
                bad = bad.where(F.col("attempt") + 1 >= attempts)
            if rejected is not None:
                epochs.append(bad.select(batch, *arrival, "serial_number", "time", "measurement"), rejected, epoch)
            if malformed is not None:
                epochs.append(broken.select(batch, "value"), malformed, epoch)
            tables.write_measurements(ingest.to_records(good, arrival), target, arrival,
                                      chunk=None if tables.chunk_width(spark, target) else chunk)
            if stats is not None:
                status = F.when(F.col("rejected"), F.lit("error")).otherwise(F.lit("success"))
                done = ingest.batch_stats(rows.withColumn("status", status), batch, ("serial_number", "status"))
                done = done.withColumn(batch, F.col(batch).cast("string"))
                done = done.withColumn("completed", F.lit(datetime.now(timezone.utc))) \
                    .withColumn("seconds", F.lit(time.monotonic() - began))
                epochs.append(done, stats, epoch)
            if retry is not None:
                # Last, since a write to a table that the readings came from makes Spark forget them: the writes above would each
                # find them gone, and parse and match the micro-batch again.
                append_epoch(failed.where(F.col("attempt") < attempts), retry, epoch)
                # Those before the last have been tried again by a micro-batch that is done.
                tables.drop_before(spark, retry, "epoch", epoch - 1)
        finally:
            matched.unpersist()
        if maintenance is not None and epoch % maintain_every == maintain_every - 1:
            maintenance(spark)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def append_epoch(rows: DataFrame, name: str, epoch: int) -> None:
    """Write the rows of a micro-batch as their own partition, replacing what an interrupted attempt at
    it has left: for a table whose older partitions are dropped as it goes."""
    spark = configure(rows.sparkSession)
    rows = rows.withColumn("epoch", F.lit(epoch).cast("bigint"))
    if spark.catalog.tableExists(name):
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    else:
        rows.write.partitionBy("epoch").format("parquet").saveAsTable(name)
