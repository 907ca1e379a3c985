"""The streaming jobs run over the benchmark tables until their input is used up.

Each run writes its messages, output and checkpoint below a fresh folder of the cluster's shared folder
and returns the output read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode, metrics
from ..session import shared_dir
from ..sources import catalog, epochs, readers, tables
from ..streaming import commands as command_stream
from ..streaming import ingest as ingest_stream
from ..streaming import logs as log_stream
from ..streaming import packing, quarantine
from ..streaming import registry as registry_stream
from . import bindings as b
from . import jobs, stored

ALL = {"availableNow": True}


#: Files the messages are spread over, and how many of them a micro-batch takes.
FILES, MAX_FILES = 6, 2
#: Commands of a file; where a cut of them has more, it is written by several tasks.
FILE_ROWS = 50_000


def _stream(spark: SparkSession, messages: DataFrame, folder: str) -> DataFrame:
    """The messages as a file stream of several micro-batches."""
    messages.repartition(FILES).write.parquet(folder)
    return readers.file_stream(spark, folder, messages.schema, max_files=MAX_FILES)


def _new_table() -> str:
    """The name of a table that the stream creates."""
    return f"tidewire_{uuid.uuid4().hex}"


def _table(df: DataFrame, folder: str, partitions=()) -> str:
    """An external catalog table in the folder."""
    name = _new_table()
    writer = df.write.format("parquet").option("path", folder)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.saveAsTable(name)
    return name


def _ingest_tables(spark: SparkSession, sf: str, work: str, chunk_catalog: bool = False) -> tuple[DataFrame, str, str]:
    sensors = _table(b.valid_sensor(spark, sf), f"{work}/sensor")
    target = _new_table()
    # Chunks of a day instead of five minutes: the events are spread over a month.
    tables.create_measurements(spark, target, "1 day", f"{work}/measurement", "bigint", chunk_catalog)
    messages = b.raw_measurements(spark, sf).select("batch_id", "arrival", "value")
    return _stream(spark, messages, f"{work}/messages"), sensors, target


def ingest(spark: SparkSession, sf: str) -> DataFrame:
    work = shared_dir(spark, "ingest")
    stream, sensors, target = _ingest_tables(spark, sf, work)
    for attempt in ("first", "replay"):
        ingest_stream.start(stream, sensors, target, f"{work}/checkpoint-{attempt}", _new_table(), _new_table(),
                            trigger=ALL).awaitTermination()
    return stored.rows(tables.fresh(spark, target))


def requeued(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the sensors are registered only after most messages have arrived."""
    work = shared_dir(spark, "requeue")
    known = b.valid_sensor(spark, sf)
    sensors, target, retry = _table(known.where("id % 2 = 0"), f"{work}/sensor"), _new_table(), _new_table()
    tables.create_measurements(spark, target, "1 day", f"{work}/measurement", "bigint", chunk_catalog=False)
    messages = b.raw_measurements(spark, sf).select("batch_id", "arrival", "value")
    late, rejected, malformed = F.col("batch_id") % 5 == 0, _new_table(), _new_table()
    stream = _stream(spark, messages.where(~late), f"{work}/messages")

    def run():
        ingest_stream.start(stream, sensors, target, f"{work}/checkpoint", rejected, malformed, retry=retry, attempts=FILES,
                            trigger=ALL).awaitTermination()
    run()
    known.where("id % 2 <> 0").select(*spark.table(sensors).columns).write.mode("append").insertInto(sensors)
    messages.where(late).repartition(FILES).write.mode("append").parquet(f"{work}/messages")
    run()
    return stored.rows(tables.fresh(spark, target))


def maintained(spark: SparkSession, sf: str) -> DataFrame:
    work = shared_dir(spark, "maintained")
    stream, sensors, target = _ingest_tables(spark, sf, work, chunk_catalog=True)

    def maintenance(session: SparkSession) -> None:
        jobs.maintain_measurements(session, target, "2024-01-20 12:00:00", keep="30 days", after="1 day")
    ingest_stream.start(stream, sensors, target, f"{work}/checkpoint", _new_table(), _new_table(), trigger=ALL,
                        maintenance=maintenance, maintain_every=1).awaitTermination()
    return stored.rows(catalog.scan(spark, target))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements by outcome and sensor, as the ingest counted them while it ran."""
    work = shared_dir(spark, "counters")
    stream, sensors, target = _ingest_tables(spark, sf, work)
    stats = _table(spark.createDataFrame([], f"{ingest_stream.STATS}, {epochs.SPAN}"), f"{work}/stats", epochs.PARTITIONS)
    ingest_stream.start(stream, sensors, target, f"{work}/checkpoint", _new_table(), _new_table(), stats=stats,
                        trigger=ALL).awaitTermination()
    return metrics.counter(epochs.read(spark, stats), ["status", "serial_number"], F.col("n"))


def dedup(spark: SparkSession, sf: str) -> DataFrame:
    work = shared_dir(spark, "dedup")
    rows = b.readings(spark, sf).select("serial_number", F.col("time").cast("timestamp").alias("time"), "measurement")
    # The newest readings come first: all others are up to a month late.
    newest = F.col("time") >= rows.agg(F.max("time")).first()[0] - F.expr("INTERVAL 1 DAY")
    for part in (newest, ~newest):
        rows.where(part).unionByName(rows).repartition(FILES).write.mode("append").parquet(f"{work}/messages")
    stream = readers.file_stream(spark, f"{work}/messages", rows.schema, max_files=MAX_FILES)
    (ingest_stream.drop_resent(stream, "1 day").writeStream.format("parquet").option("path", f"{work}/out")
     .option("checkpointLocation", f"{work}/checkpoint").trigger(**ALL).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(f"{work}/out").withColumn(
        "time", F.col("time").cast("timestamp_ntz"))


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Registers every customer against a registry that is empty at first."""
    work = shared_dir(spark, "registry")
    sensors = _table(b.sensor(spark, sf).limit(0), f"{work}/sensor")
    stream = _stream(spark, b.raw_registrations(spark, sf), f"{work}/messages")
    registry_stream.start(stream, sensors, f"{work}/checkpoint", _new_table(), trigger=ALL).awaitTermination()
    return tables.fresh(spark, sensors).select("serial_number", "sample_frequency")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    work = shared_dir(spark, "logs")
    stream = _stream(spark, b.raw_logs(spark, sf), f"{work}/messages")
    log_stream.start(stream, f"{work}/out", f"{work}/checkpoint", _new_table(), trigger=ALL).awaitTermination()
    parsed = decode.parse_log_lines(spark.read.text(f"{work}/out").select("value"))
    return parsed.withColumn("time", F.col("time").cast("timestamp_ntz"))


def _commands(spark: SparkSession, sf: str, work: str) -> tuple[DataFrame, DataFrame]:
    initial = b.sensor(spark, sf).select("serial_number", F.lit(False).alias("asleep"), "sample_frequency")
    messages = b.raw_commands(spark, sf)
    low, high = messages.agg(F.min("arrival"), F.max("arrival")).first()
    cuts = [low + (high + 1 - low) * k // FILES for k in range(FILES + 1)]
    within = [(F.col("arrival") >= start) & (F.col("arrival") < end) for start, end in zip(cuts, cuts[1:])]
    # As many files of each cut, none of them empty, so that a micro-batch takes whole cuts.
    parts = max(1, min(messages.agg(*[F.approx_count_distinct(F.when(w, F.col("arrival"))) for w in within]).first()) // FILE_ROWS)
    for cut in within:  # one after the other, since files are read in the order they were written
        rows = messages.where(cut)
        rows = rows.repartition(parts, "arrival") if parts > 1 else rows.coalesce(1)
        rows.write.mode("append").parquet(f"{work}/messages")
    stream = readers.file_stream(spark, f"{work}/messages", messages.schema, max_files=MAX_FILES * parts)
    quarantine.start(stream, decode.commands, _new_table(), f"{work}/malformed", ALL).awaitTermination()
    return decode.commands(stream)[0], initial


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """State of every sensor before and after each of its commands."""
    work = shared_dir(spark, "commands")
    rows, initial = _commands(spark, sf, work)
    command_stream.start(rows, initial, f"{work}/out", f"{work}/checkpoint", trigger=ALL).awaitTermination()
    out = spark.read.schema(command_stream.OUTPUT).parquet(f"{work}/out/states")
    return out.select("serial_number", "arrival", "was_asleep", "was_hz", "asleep", "hz")


def reports(spark: SparkSession, sf: str, form: str) -> DataFrame:
    """Log records caused by the commands, from the keyed or the folded stream."""
    work = shared_dir(spark, "reports")
    rows, initial = _commands(spark, sf, work)
    if form == "keyed":
        query = command_stream.start(rows, initial, f"{work}/out", f"{work}/checkpoint", trigger=ALL)
    else:
        state = _table(spark.createDataFrame([], command_stream.STATE), f"{work}/state", ["epoch"])
        query = command_stream.start_folded(rows, initial, state, f"{work}/out", f"{work}/checkpoint", trigger=ALL)
    query.awaitTermination()
    return spark.read.parquet(f"{work}/out/reports").drop("epoch").withColumn(
        "time", F.col("time").cast("timestamp_ntz"))


def pack(spark: SparkSession, sf: str) -> DataFrame:
    """The readings found in the messages of the packing stream, with the period of their message."""
    work = shared_dir(spark, "pack")
    rows = b.readings(spark, sf).select("serial_number", F.col("time").cast("timestamp").alias("time"), "measurement")
    stream = _stream(spark, rows, f"{work}/messages")
    packing.start(stream, f"{work}/out", f"{work}/checkpoint", trigger=ALL).awaitTermination()
    sent = spark.read.parquet(f"{work}/out").select("period_start", "value")
    found, _ = decode.measurements(sent)
    return found.select("serial_number", F.col("period_start").cast("timestamp_ntz").alias("period_start"),
                        F.col("time").cast("timestamp_ntz").alias("time"), "measurement")
