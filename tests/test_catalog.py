"""The stored chunk catalog: what it knows after every kind of write, what reads it spares, and writes that break off."""

import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_tables import batch, stored

from tidewire.operators import lifecycle
from tidewire.plans import jobs
from tidewire.sources import catalog, tables


def readings(spark, data):
    return batch(spark, [(s, t, 1.0, i) for i, (s, t) in enumerate(data)])


def known(spark, name):
    """The catalog against the table itself: equal in all but the flags."""
    cols = ["chunk_start", "hash_part", "row_count", "min_sensor_id", "max_sensor_id", "min_time", "max_time", "n_sensors"]
    want = tables.fresh(spark, name).groupBy("chunk_start", "hash_part").agg(
        F.count("*").alias("row_count"), F.min("sensor_id").cast("bigint").alias("min_sensor_id"), F.max("sensor_id").cast("bigint").alias("max_sensor_id"),
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count_distinct("sensor_id").alias("n_sensors"))
    got = catalog.chunks(spark, name)
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    return {(str(r.chunk_start), r.hash_part): r for r in got.collect()}


DAY = "2024-01-0{} {:02d}:00:00"


def seed(spark, name):
    tables.create_measurements(spark, name, "1 day")
    tables.write_measurements(readings(spark, [(s, DAY.format(d, h)) for d in (1, 2, 5) for h in (1, 9) for s in (1, 2, 5, 40_000, 100_000)]), name, ["arrival"])


def test_appends_compaction_delete_retention_and_fold(spark, name):
    seed(spark, name)
    assert not any(r.compacted for r in known(spark, name).values())
    assert tables.compact(spark, name, "1 day", "2024-01-04 00:00:00") == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    got = known(spark, name)
    assert {k for k, r in got.items() if r.compacted} == {(f"2024-01-0{d} 00:00:00", p) for d in (1, 2) for p in (0, 1, 2)}
    on_disk = {}
    for folder, _, files in os.walk(catalog.location(spark, name).removeprefix("file:")):
        if "hash_part=" in folder:
            start, part = folder.split("/")[-2:]
            on_disk[start.split("=")[1].replace("%3A", ":"), int(part.split("=")[1])] = sum(
                os.path.getsize(f"{folder}/{f}") for f in files if f.endswith(".parquet"))
    assert all(r.bytes_before > 0 and r.bytes_after == on_disk[k] for k, r in got.items() if r.compacted)
    assert all(r.bytes_after is None for r in got.values() if not r.compacted)
    assert tables.compact(spark, name, "1 day", "2024-01-04 00:00:00") == []
    # A late reading: its chunk is due again, the others are not.
    tables.write_measurements(readings(spark, [(9, DAY.format(1, 5))]), name, ["arrival"])
    assert not known(spark, name)["2024-01-01 00:00:00", 1].compacted
    catalog.fold(spark, name)
    assert sum(r.compacted for r in known(spark, name).values()) == 5
    assert tables.compact(spark, name, "1 day", "2024-01-04 00:00:00") == ["2024-01-01 00:00:00"]
    assert sum(r.compacted for r in known(spark, name).values()) == 6
    tables.delete_measurements(spark, name, spark.createDataFrame([(1,), (2,)], "sensor_id int"))
    known(spark, name)
    assert tables.apply_retention(spark, name, "1 day", "2024-01-03 12:00:00") > 0
    assert {k[0] for k in known(spark, name)} == {"2024-01-02 00:00:00", "2024-01-05 00:00:00"}
    catalog.fold(spark, name)
    assert {k[0] for k in known(spark, name)} == {"2024-01-02 00:00:00", "2024-01-05 00:00:00"}
    assert len(spark.sql(f"SHOW PARTITIONS {name}_chunks").collect()) == 1


def filters(df):
    """Files that a scan opens."""
    return len(df.select(F.input_file_name().alias("f")).distinct().collect())


def test_a_scan_reads_only_the_chunks_that_hold_its_sensors(spark, name):
    seed(spark, name)
    named = catalog.holding(spark, name, [1, 40_000])
    assert rows(named.select(F.col("chunk_start").cast("string"), "hash_part")) == sorted(
        [(f"2024-01-0{d} 00:00:00", p) for d in (1, 2, 5) for p in (0, 1)], key=str)
    assert catalog.holding(spark, name, [3, 4, 32_768, 7_232, -5]).count() == 0
    assert catalog.holding(spark, name, min_sensor=3, max_sensor=4).count() == 0
    assert catalog.holding(spark, name, min_sensor=3, max_sensor=5).count() == 3
    assert catalog.holding(spark, name, [5], start="2024-01-02 00:00:00", end="2024-01-02 01:00:00").count() == 0
    got = catalog.scan(spark, name, [2, 100_000], start="2024-01-01 02:00:00", end="2024-01-03 00:00:00")
    assert got.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [" in plan and "hash_part" in plan.split("PartitionFilters")[1]
    read = catalog.within(catalog.ranges(catalog.holding(spark, name, [2], start="2024-01-05 00:00:00"), "chunk_start", "hash_part"),
                          "chunk_start", spark.table(name).schema["chunk_start"].dataType, "hash_part")
    assert rows(spark.table(name).where(read).select(F.col("chunk_start").cast("string"), "hash_part").distinct()) == [("2024-01-05 00:00:00", 2)]


def test_ranges_cover_and_merge_across_the_narrowest_gaps(spark):
    days = spark.createDataFrame([(0, f"2024-01-{d:02d} 00:00:00") for d in (1, 2, 3, 10, 11, 30)] + [(1, "2024-02-01 00:00:00"), (1, None)], "p int, t string")
    days = days.withColumn("t", F.col("t").cast("timestamp"))
    d = "2024-01-{:02d} 00:00:00".format
    assert catalog.ranges(days, "t", "p") == [(0, d(k), d(k)) for k in (1, 2, 3, 10, 11, 30)] + [(1, "2024-02-01 00:00:00", "2024-02-01 00:00:00")]
    assert catalog.ranges(days.where("p = 0"), "t", most=2) == [(None, d(1), d(3)), (None, d(10), d(11)), (None, d(30), d(30))]
    assert catalog.ranges(days.limit(0), "t") == []


def test_a_straggler_adds_its_own_chunk_only(spark, name):
    tables.create_measurements(spark, name, "1 day")
    tables.write_measurements(readings(spark, [(1, f"2023-{m:02d}-15 00:00:00") for m in range(1, 13)]), name, ["arrival"])
    late = lifecycle.with_chunk(readings(spark, [(1, "2023-01-15 00:00:00"), (1, "2023-12-15 00:00:01")]), width="1 day")
    assert filters(tables.touched(late, tables.fresh(spark, name), "chunk_start")) == 2
    tables.write_measurements(late.drop("chunk_start", "hash_part"), name, ["arrival"])
    assert tables.fresh(spark, name).count() == 13


def test_writes_that_break_off_are_repaired(spark, name):
    seed(spark, name)
    more = lifecycle.with_chunk(readings(spark, [(7, DAY.format(2, 3)), (8, DAY.format(7, 3))]).drop("arrival"), width="1 day")
    more = more.select(*tables.fresh(spark, name).columns)

    def fails(_):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        catalog.record(more, name, fails)
    # Claims too much, never too little.
    assert catalog.holding(spark, name, [8]).count() == 1
    catalog.repair(spark, name)
    known(spark, name)

    def breaks_off(df):
        tables.append(df, name, tables.MEASUREMENT_PARTITIONS)
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        catalog.record(more, name, breaks_off)
    assert catalog.scan(spark, name, [7, 8]).count() == 2
    tables.write_measurements(readings(spark, [(1, DAY.format(9, 1))]), name, ["arrival"])
    assert known(spark, name)["2024-01-07 00:00:00", 0].row_count == 1


def test_width_is_the_tables_own(spark, name):
    tables.create_measurements(spark, name, "1 day")
    rows_ = readings(spark, [(1, "2024-01-02 00:02:00"), (1, "2024-01-02 23:58:00")])
    tables.write_measurements(rows_, name, ["arrival"])
    tables.write_measurements(rows_, name, ["arrival"], chunk="24 hours")
    with pytest.raises(ValueError):
        tables.write_measurements(rows_, name, ["arrival"], chunk="5 minutes")
    assert len(stored(spark, name)) == 2
    # A chunk of today is not over after five minutes.
    assert jobs.maintain_measurements(spark, name, "2024-01-02 23:59:00") == []
    assert len(stored(spark, name)) == 2
    assert jobs.maintain_measurements(spark, name, "2024-01-03 00:20:00") == ["2024-01-02 00:00:00"]
    assert len(stored(spark, name)) == 2
    assert jobs.maintain_measurements(spark, name, "2024-01-03 00:30:00") == [] and stored(spark, name) == []


def test_a_table_that_does_not_say_its_width(spark, name):
    tables.create(lifecycle.with_chunk(spark.createDataFrame([], "time timestamp, sensor_id int, measurement double")), name, tables.MEASUREMENT_PARTITIONS)
    one = readings(spark, [(1, "2024-01-02 00:02:00")])
    with pytest.raises(ValueError):
        tables.apply_retention(spark, name, "1 day", datetime(2024, 2, 1))
    with pytest.raises(ValueError):
        tables.write_measurements(one, name, ["arrival"])
    tables.write_measurements(one, name, ["arrival"], chunk="1 day")
    with pytest.raises(ValueError):
        tables.write_measurements(one, name, ["arrival"], chunk="5 minutes")
    tables.write_measurements(one, name, ["arrival"])
    assert len(stored(spark, name)) == 1


def test_compaction_refuses_to_overwrite_what_it_has_not_read(spark, name, monkeypatch):
    seed(spark, name)
    files, calls = tables._files, []

    def seen(*args):
        calls.append(1)
        if len(calls) == 2:  # between staging and overwriting
            tables.append(lifecycle.with_chunk(readings(spark, [(77, DAY.format(1, 7))]).drop("arrival"), width="1 day").select(
                *spark.table(name).columns), name, tables.MEASUREMENT_PARTITIONS)
        return files(*args)
    monkeypatch.setattr(tables, "_files", seen)
    with pytest.raises(tables.ConcurrentWriteError):
        tables.compact(spark, name, "1 day", "2024-01-04 00:00:00")
    assert tables.fresh(spark, name).where("sensor_id = 77").count() == 1 and tables.fresh(spark, name).count() == 31


def test_newest_rows_are_read_from_the_newest_chunks(spark, name, monkeypatch):
    tables.create_measurements(spark, name, "1 day")
    tables.write_measurements(readings(spark, [(s, f"2024-01-{d:02d} 0{h}:00:00") for d in range(1, 11) for h in (1, 2) for s in (1, 2, 5)
                                               if not (s == 5 and d > 4)]), name, ["arrival"])
    read, staged = [], catalog.staged

    def seen(df, what):
        if what == "newest":
            read.append(what)
        return staged(df, what)
    monkeypatch.setattr(catalog, "staged", seen)
    sensors = spark.createDataFrame([(1,), (5,), (99,), (None,)], "sensor_id int")
    got = catalog.newest(spark, name, sensors)
    assert rows(got.select("sensor_id", F.col("time").cast("string"))) == [(1, "2024-01-10 02:00:00"), (5, "2024-01-04 02:00:00")]
    # Two rounds: the newest chunk, then the two newest that hold sensor 5; nobody looks for 99.
    assert read == ["newest"] * 2
    assert rows(catalog.newest(spark, name, sensors.where("sensor_id = 99"))) == []
    assert catalog.newest(spark, name, sensors.limit(0)).count() == 0


def test_summary_builds_no_bitmap_twice(spark):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 00:00:0{i % 7}", i % 2, None if i % 50 == 0 else (i * 7919) % 70_000) for i in range(600)] * 2,
                                 "time string, hash_part int, sensor_id bigint").withColumn("time", F.col("time").cast("timestamp"))
    rows = rows.withColumn("chunk_start", F.date_trunc("day", "time")).repartition(5)
    found = catalog.summary(rows)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    partial = next(i for i, line in enumerate(plan) if "partial_bitmap_construct_agg" in line)
    # Between the two steps of the aggregate no bitmap moves.
    assert not any("Exchange" in line for line in plan[:partial])
    want = rows.groupBy(*catalog.KEY, F.bitmap_bucket_number("sensor_id").alias("bucket")).agg(
        F.count("*").alias("row_count"), F.min("sensor_id").alias("min_sensor_id"), F.max("sensor_id").alias("max_sensor_id"),
        F.min("time").alias("min_time"), F.max("time").alias("max_time"),
        F.bitmap_construct_agg(F.bitmap_bit_position("sensor_id")).alias("sensors"))
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
