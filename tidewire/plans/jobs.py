"""The scheduled jobs: one statistics tick, and table maintenance. The caller schedules them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest, lifecycle, snapshots
from ..schemas import KEYS
from ..session import shared_dir
from ..sources import catalog, tables

#: Tables without a conflict clause: recording a tick twice is an error there.
STRICT = ("snapshots", "sizes")
#: History tables that are trimmed; the others are kept.
TRIMMED = ("table_stats", "database_stats", "connection_stats")


def create_history(frames: Mapping[str, DataFrame], names: Mapping[str, str]) -> None:
    """Create the history tables from the frames of a tick, empty."""
    for key, df in frames.items():
        if key == "queries":
            tables.create(df.limit(0), names[key])
        else:
            tables.create_history(df, names[key])


def record_tick(inputs: Mapping[str, DataFrame], as_of, names: Mapping[str, str], stats_reset=None,
                datname: str | None = snapshots.DATABASE) -> DataFrame | None:
    """Append everything one tick records; returns the ids of the query texts that were new.

    The joined statements feed three tables and are computed once. A tick that was cut short is finished by
    recording it again: what it has written already is skipped. Recording a finished tick again is an error.
    """
    base = None
    if "statements" in inputs:
        base = snapshots.statement_base(inputs["statements"], inputs["kcache"], inputs["roles"],
                                        inputs["databases"], datname).persist(StorageLevel.MEMORY_AND_DISK)
    new_texts = None
    try:
        frames = snapshots.take(inputs, as_of, stats_reset, datname, base)
        # The strict tables come last, so a tick is finished when all of them that get rows hold it.
        strict = [key for key in frames if key in STRICT and not frames[key].isEmpty()]
        held = [key for key in strict if tables.holds_any(frames[key], names[key], KEYS[key])]
        if strict and held == strict:
            raise ingest.DuplicateKeyError(f"tick {as_of} is recorded already")
        for key, df in frames.items():
            if key == "queries":
                new_texts = _upsert_texts(df, names[key])
            elif key not in STRICT:
                tables.write_history(df, names[key], KEYS[key], "ignore")
        for key in strict:
            if key not in held:
                tables.write_history(frames[key], names[key], KEYS[key], "error")
    finally:
        if base is not None:
            base.unpersist()
    return new_texts


def _upsert_texts(df: DataFrame, name: str) -> DataFrame:
    """Insert the texts the table lacks; returns the inserted ids."""
    spark = df.sparkSession
    target = tables.fresh(spark, name)
    # Written down first: the insert changes what the new rows are derived from.
    staged = shared_dir(spark, "new-queries")
    ingest.only_new(df, target, KEYS["queries"]).select(*target.columns).write.parquet(staged)
    new = spark.read.schema(target.schema).parquet(staged)
    tables.append(new, name)
    return new.select("queryid")


def maintain_measurements(spark: SparkSession, name: str, as_of, compacted: Sequence[str] = (), keep: str = lifecycle.MEASUREMENT_RETENTION,
                          after: str = lifecycle.MEASUREMENT_COMPACT_AFTER) -> list[str]:
    """Retention, then compaction of the chunks that are due, then the catalog's log folded; returns the starts of all compacted
    chunks. A table with a catalog knows which chunks it has compacted: `compacted` is for those without."""
    tables.apply_retention(spark, name, keep, as_of)
    done = tables.compact(spark, name, after, as_of, compacted)
    if catalog.of(spark, name):
        catalog.fold(spark, name)
    return [*compacted, *done]


def trim_history(spark: SparkSession, names: Mapping[str, str], as_of) -> int:
    """Drop the days of the trimmed history tables that are past their retention."""
    return sum(
        tables.apply_retention(spark, names[key], lifecycle.HISTORY_RETENTION, as_of, ["created_day"], lifecycle.HISTORY_CHUNK)
        for key in TRIMMED if key in names
    )
