"""Write semantics, deletes, retention and compaction on real tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewire.operators import lifecycle, registry, snapshots
from tidewire.operators.ingest import DuplicateKeyError
from tidewire.sources import readers, tables

KEYS = "sensor_id int, t string, measurement double, arrival int"


def batch(spark, data):
    return spark.createDataFrame(data, KEYS).select(
        F.col("t").cast("timestamp").alias("time"), "sensor_id", "measurement", "arrival")


def stored(spark, name):
    return rows(spark.table(name).select(F.col("time").cast("string"), "sensor_id", "measurement"))


A = ("2024-01-01 00:00:01", 1)


def test_first_write_wins(spark, name):
    tables.create_measurements(spark, name)
    first = batch(spark, [(1, "2024-01-01 00:00:01", 1.0, 5), (1, "2024-01-01 00:00:01", 2.0, 3),
                          (2, "2024-01-01 00:06:00", 7.0, 4), (1, "2024-01-01 00:00:01.000001", 9.0, 6)])
    tables.write_measurements(first, name, ["arrival"])
    want = [("2024-01-01 00:00:01", 1, 2.0), ("2024-01-01 00:00:01.000001", 1, 9.0), ("2024-01-01 00:06:00", 2, 7.0)]
    assert stored(spark, name) == want
    tables.write_measurements(first, name, ["arrival"])  # replay
    assert stored(spark, name) == want
    later = batch(spark, [(1, "2024-01-01 00:00:01", 8.0, 0), (3, "2023-12-31 10:00:00", 3.0, 1)])
    tables.write_measurements(later, name, ["arrival"])
    assert stored(spark, name) == [("2023-12-31 10:00:00", 3, 3.0), *want]
    tables.write_measurements(later.limit(0), name, ["arrival"])  # empty batch
    assert len(stored(spark, name)) == 4


def test_many_touched_partitions(spark, name):
    tables.create_measurements(spark, name)
    data = batch(spark, [(i, f"2024-01-01 0{i}:00:00", float(i), i) for i in range(6)])
    tables.write_measurements(data, name, ["arrival"])
    tables.write_measurements(data, name, ["arrival"])
    assert len(stored(spark, name)) == 6


def test_a_large_batch_is_written_whole(spark, name):
    tables.create_measurements(spark, name)
    big = spark.range(60_000).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000).alias("time"),
        (F.col("id") % 3).cast("int").alias("sensor_id"), F.col("id").cast("double").alias("measurement"),
        F.col("id").alias("arrival"))
    tables.write_measurements(big, name, ["arrival"])
    tables.write_measurements(big, name, ["arrival"])
    assert spark.table(name).count() == 60_000


def test_error_mode(spark, name):
    tables.create_measurements(spark, name)
    one = batch(spark, [(1, "2024-01-01 00:00:01", 1.0, 0)])
    tables.write_measurements(one, name, ["arrival"], "error")
    with pytest.raises(DuplicateKeyError):
        tables.write_measurements(one, name, ["arrival"], "error")
    twice = batch(spark, [(2, "2024-01-01 00:00:01", 1.0, 0), (2, "2024-01-01 00:00:01", 2.0, 1)])
    with pytest.raises(DuplicateKeyError):
        tables.write_measurements(twice, name, ["arrival"], "error")
    assert len(stored(spark, name)) == 1
    with pytest.raises(ValueError):
        tables.write_measurements(one, name, ["arrival"], "merge")


def test_target_scan_is_pruned_to_touched_partitions(spark, name):
    tables.create_measurements(spark, name)
    tables.write_measurements(batch(spark, [(1, "2024-01-01 00:00:01", 1.0, 0), (1, "2024-02-01 00:00:01", 1.0, 1)]),
                              name, ["arrival"])
    new = lifecycle.with_chunk(batch(spark, [(1, "2024-02-01 00:00:02", 1.0, 0)]))
    plan = tables.touched(new, spark.table(name), "chunk_start")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_start" in plan or "PartitionFilters: [(chunk_start" in plan
    assert "2024-02-01" in plan or "1706745600000000" in plan


def seed(spark, name):
    tables.create_measurements(spark, name)
    tables.write_measurements(batch(spark, [
        (s, f"2024-01-01 00:{m:02d}:0{k}", float(s * 100 + m), i)
        for i, (s, m, k) in enumerate((s, m, k) for s in (1, 2, 5) for m in (0, 4, 5, 11, 29) for k in (1, 2))
    ]), name, ["arrival"])


def chunks(spark, name):
    return sorted(r[0] for r in spark.table(name).select(F.col("chunk_start").cast("string")).distinct().collect())


def test_retention_drops_whole_chunks(spark, name):
    seed(spark, name)
    before = spark.table(name).select("time", "sensor_id", "measurement")
    want = rows(lifecycle.retained(before, "30 minutes", "2024-01-01 00:36:00"))
    # The chunk 00:00-00:05 ended 31 minutes ago, 00:05-00:10 only 26 minutes ago.
    assert tables.apply_retention(spark, name, "30 minutes", "2024-01-01 00:36:00") == 2
    assert chunks(spark, name)[0] == "2024-01-01 00:05:00"
    assert rows(spark.table(name).select("time", "sensor_id", "measurement")) == want
    # A chunk that ended exactly `keep` ago expires.
    assert tables.apply_retention(spark, name, "30 minutes", "2024-01-01 00:40:00") == 2
    assert chunks(spark, name)[0] == "2024-01-01 00:10:00"


def test_compaction_keeps_the_rows_and_sorts_the_files(spark, name):
    seed(spark, name)
    before = stored(spark, name)
    done = tables.compact(spark, name, "15 minutes", "2024-01-01 00:30:00")
    assert done == ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:10:00"]
    assert stored(spark, name) == before
    files = spark.table(name).where("chunk_start < '2024-01-01 00:15:00'").select(
        F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"), "sensor_id", "time")
    for f in {r.f for r in files.collect()}:
        order = [(r.sensor_id, -r.time.timestamp()) for r in files.where(F.col("f") == f).orderBy("i").collect()]
        assert order == sorted(order)
    assert tables.compact(spark, name, "15 minutes", "2024-01-01 00:30:00", done) == []


def test_delete_drops_partitions_left_empty(spark, name):
    seed(spark, name)
    tables.delete_measurements(spark, name, spark.createDataFrame([(1,), (5,), (99,)], "sensor_id int"))
    left = spark.table(name)
    assert {r.sensor_id for r in left.collect()} == {2} and left.count() == 10
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    assert parts and all(p.endswith("hash_part=2") for p in parts)


def test_history(spark, name):
    activity = spark.createDataFrame([("iot", None), ("iot", "unknown"), ("iot", "active"), ("x", "idle")],
                                     "datname string, state string")
    tick = snapshots.connection_stats(activity, "2024-01-01 00:00:15")
    assert rows(tick.select("state", "connection_count")) == [("active", 1), ("unknown", 2)]
    keys = ["created", "datname", "state"]
    tables.create_history(tick, name)
    tables.write_history(tick, name, keys)
    tables.write_history(tick, name, keys)
    assert spark.table(name).count() == 2
    with pytest.raises(DuplicateKeyError):
        tables.write_history(tick, name, keys, "error")
    tables.write_history(snapshots.connection_stats(activity, "2024-01-09 00:00:15"), name, keys)
    assert tables.apply_retention(spark, name, "7 days", "2024-01-09 12:00:00", ["created_day"], "1 day") == 1
    assert {str(r.created_day) for r in spark.table(name).collect()} == {"2024-01-09"}


def test_table_sizes_and_files(spark, name, tmp_path):
    seed(spark, name)
    spark.range(1000).write.parquet(f"{tmp_path}/a")
    spark.range(10).write.parquet(f"{tmp_path}/b")
    got = {r.hypertable_name: r.table_bytes for r in
           tables.table_sizes(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}).collect()}
    on_disk = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in "ab"}
    assert got == {n: on_disk[n] - min((f.stat().st_size for f in (tmp_path / n).glob("*.parquet")
                                        if not spark.read.parquet(str(f)).count()), default=0) for n in "ab"}
    catalog = tables.file_catalog(spark, name)
    assert catalog.count() == spark.sql(f"SHOW PARTITIONS {name}").count()


def test_compression_ratio(spark):
    cat = spark.createDataFrame([("m", 100, 20, True), ("m", 60, 20, True), ("m", 5, 5, False)],
                                "table_name string, bytes_before int, bytes_after int, compacted boolean")
    r = lifecycle.compression_ratio(cat).first()
    assert (r.chunks, r.bytes_before, r.bytes_after, r.ratio) == (2, 160, 40, 4.0)


def test_foreign_view(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    readers.foreign_view(spark, "iot_pg_stat_user_tables", f"{tmp_path}/t")
    assert spark.table("iot_pg_stat_user_tables").count() == 3


def test_registry_ids_are_unique_and_above_the_old(spark):
    dim = spark.createDataFrame([(7, "a", 1.0)], "id int, serial_number string, sample_frequency double")
    new = spark.createDataFrame([("b", 2.0, 2), ("b", 3.0, 1), ("a", 9.0, 0), *[(f"n{i}", 1.0, 9) for i in range(500)]],
                                "serial_number string, sample_frequency double, arrival int")
    got = registry.insert_missing(new, dim, "serial_number", ["arrival"]).collect()
    assert sorted(r.id for r in got) == list(range(8, 8 + 501))
    assert [r.sample_frequency for r in got if r.serial_number == "b"] == [3.0]
    empty = registry.insert_missing(new, dim.limit(0), "serial_number", ["arrival"])
    assert sorted(r.id for r in empty.collect()) == list(range(1, 503))


def test_lookup_errors_when_absent(spark):
    dim = spark.createDataFrame([(7, "a", 1.0)], "id int, serial_number string, sample_frequency double")
    assert registry.sensor_id_by_serial(dim, "a") == 7
    with pytest.raises(registry.NotFoundError):
        registry.sensor_id_by_serial(dim, "zz")
    assert rows(registry.sensor_by_serial(dim, "a")) == [("a", 1.0)]


def test_cascades(spark):
    frames = {
        "target": spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"),
        "target_location": spark.createDataFrame([(1, 5), (2, 6)], "target_id int, l int"),
        "sensor": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, target_id int"),
        "measurement": spark.createDataFrame([(10, 0.1), (10, 0.2), (11, 0.3), (12, 0.4)], "sensor_id int, v double"),
    }
    left = registry.delete_cascade(frames, "target", frames["target"].where("id = 1"))
    assert rows(left["target"]) == [(2, "y")]
    assert rows(left["target_location"]) == [(2, 6)]
    assert rows(left["sensor"]) == [(11, 2), (12, None)]
    assert rows(left["measurement"]) == [(11, 0.3), (12, 0.4)]
    same = registry.delete_cascade(frames, "sensor", frames["sensor"].where("id = 99"))
    assert {n: same[n].count() for n in frames} == {"target": 2, "target_location": 2, "sensor": 3, "measurement": 4}


def test_messages_with_an_unknown_serial_are_rejected_whole(spark):
    from tidewire.operators import ingest

    sensor = spark.createDataFrame([(1, "A"), (2, "B")], "id int, serial_number string")
    data = [(b_, s) for b_, s in [(1, "A"), (1, "X"), (2, "B"), (3, "Y"), (3, "B"), (3, "A"), (4, "A"), (None, "Z"), (None, "A")]]
    m = ingest.match_sensors(spark.createDataFrame(data, "batch_id int, serial_number string"), sensor)
    got = ingest.mark_rejected(m)
    assert rows(got.where("rejected").select("batch_id")) == rows(spark.createDataFrame([(1,), (1,), (3,), (3,), (3,), (None,), (None,)], "i int"))
    assert got.count() == 9


def test_a_range_on_day_chunks_loses_no_rows(spark, name):
    from tidewire.operators import series

    tables.create_measurements(spark, name, "1 day")
    assert tables.chunk_width(spark, name) == "1 day"
    data = batch(spark, [(1, f"2024-01-{d:02d} {h:02d}:00:00", 1.0, d * 24 + h) for d in range(9, 13) for h in range(24)])
    tables.write_measurements(data, name, ["arrival"], chunk="1 day")
    sensor = spark.createDataFrame([(1, "A")], "id int, serial_number string")
    for chunk in ("1 day", None):
        got = series.read_series(tables.fresh(spark, name), sensor, ["A"], "2024-01-10 12:00:00", "2024-01-12 21:00:00", chunk=chunk)
        assert got.count() == 57
    plan = series.in_range(tables.fresh(spark, name), "2024-01-10 12:00:00", "2024-01-11 00:00:00", chunk="1 day")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "chunk_start" in text.split("PartitionFilters")[1]
