import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_snapshots import inputs
from test_tables import batch

from tidewire.operators import snapshots
from tidewire.operators.ingest import DuplicateKeyError
from tidewire.plans import jobs
from tidewire.schemas import KEYS
from tidewire.sources import readers, tables
from tidewire.streaming import ingest as ingest_stream


def test_ticks(spark, name):
    first, second = "2024-01-01 00:00:15", "2024-01-01 00:00:30"
    src = inputs(spark)
    names = {k: f"{name}_{k}" for k in snapshots.take(src, first)}
    jobs.create_history(snapshots.take(src, first), names)
    assert rows(jobs.record_tick(src, first, names)) == [(100,), (200,)]
    assert rows(jobs.record_tick(src, second, names)) == []
    counts = {k: tables.fresh(spark, n).count() for k, n in names.items()}
    assert counts == {"queries": 2, "snapshots": 2, "statements": 4, "connection_stats": 2, "sizes": 2}
    with pytest.raises(DuplicateKeyError):
        jobs.record_tick(src, second, names)
    # A tick that broke off after its first strict table is finished by recording it again.
    third = "2024-01-01 00:00:45"
    part = snapshots.take(src, third)
    tables.write_history(part["snapshots"], names["snapshots"], KEYS["snapshots"], "error")
    jobs.record_tick(src, third, names)
    counts = {k: tables.fresh(spark, n).count() for k, n in names.items()}
    assert counts == {"queries": 2, "snapshots": 3, "statements": 6, "connection_stats": 3, "sizes": 3}
    with pytest.raises(DuplicateKeyError):
        jobs.record_tick(src, third, names)
    assert tables.fresh(spark, names["statements"]).count() == 6
    grown = snapshots.delta(tables.fresh(spark, names["statements"]), ["queryid", "rolname", "datname"], ["calls"])
    assert sorted(str(r.d_calls) for r in grown.collect()) == ["0", "0", "0", "0", "None", "None"]
    assert jobs.trim_history(spark, {"connection_stats": names["connection_stats"]}, "2024-01-09 00:00:00") == 1
    assert tables.fresh(spark, names["connection_stats"]).count() == 0


def test_tick_without_statements_is_finished_too(spark, name):
    src = inputs(spark)
    src["statements"] = src["statements"].limit(0)
    names = {k: f"{name}_{k}" for k in snapshots.take(src, "2024-01-01")}
    jobs.create_history(snapshots.take(src, "2024-01-01"), names)
    jobs.record_tick(src, "2024-01-01 00:00:15", names)
    assert tables.fresh(spark, names["snapshots"]).isEmpty() and tables.fresh(spark, names["sizes"]).count() == 1
    with pytest.raises(DuplicateKeyError):
        jobs.record_tick(src, "2024-01-01 00:00:15", names)


def test_maintenance(spark, name):
    tables.create_measurements(spark, name)
    tables.write_measurements(batch(spark, [(1, f"2024-01-01 00:{m:02d}:00", float(m), m) for m in range(0, 60, 2)]),
                              name, ["arrival"])
    done = jobs.maintain_measurements(spark, name, "2024-01-01 01:00:00")
    left = tables.fresh(spark, name)
    # Chunks that ended by 00:30 are gone, those that ended by 00:45 are compacted.
    assert left.agg(F.min("time").cast("string")).first()[0] == "2024-01-01 00:30:00" and left.count() == 15
    assert done == [f"2024-01-01 00:{m}:00" for m in (30, 35, 40)]
    assert jobs.maintain_measurements(spark, name, "2024-01-01 01:05:00", done) == [*done, "2024-01-01 00:45:00"]


def test_messages_from_files(spark, name, tmp_path):
    tables.create(spark.createDataFrame([(1, "A")], "id int, serial_number string"), f"{name}_sensor")
    tables.create_measurements(spark, name)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('[{"SerialNumber":"A","Timestamp":"2024-01-01T00:00:01Z","Value":1}]')
    (folder / "2.json").write_text('[{"SerialNumber":"A","Timestamp":"2024-01-01T00:00:01Z","Value":2},\n'
                                   '{"SerialNumber":"A","Timestamp":"2024-01-01T00:00:02Z","Value":3}]')
    (folder / "3.json").write_text("oops")
    stream = readers.message_files(spark, str(folder), max_files=1)
    ingest_stream.start(stream, f"{name}_sensor", name, str(tmp_path / "c"), f"{name}_rejected", f"{name}_malformed",
                        stats=f"{name}_stats", trigger={"availableNow": True}).awaitTermination()
    assert rows(tables.fresh(spark, name).select("sensor_id", F.second("time"), "measurement")) == [
        (1, 1, 1.0), (1, 2, 3.0)]
    assert tables.fresh(spark, f"{name}_stats").agg(F.sum("n")).first()[0] == 3
