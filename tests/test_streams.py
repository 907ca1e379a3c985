"""Streaming jobs: replay, rejection policies, restart, and agreement with the batch functions."""

import time

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewire.operators import commands as ops
from tidewire.operators import decode, ingest
from tidewire.sources import readers, tables
from tidewire.streaming import commands, logs, packing, quarantine, registry
from tidewire.streaming import ingest as ingest_stream

ALL = {"availableNow": True}


def message(*readings):
    return "[" + ",".join(
        f'{{"SerialNumber":"{s}","Timestamp":"2024-01-01T00:00:{t:02d}Z","Value":{v}}}' for s, t, v in readings) + "]"


def put(spark, folder, data, schema="batch_id int, arrival int, value string"):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def world(spark, name, tmp_path):
    tables.create(spark.createDataFrame([(1, "A"), (2, "B")], "id int, serial_number string"), f"{name}_sensor")
    tables.create_measurements(spark, name, chunk_catalog=False)
    folder = f"{tmp_path}/in"

    def run(checkpoint="c1", **kw):
        stream = readers.file_stream(spark, folder, "batch_id int, arrival int, value string", max_files=1)
        kw = {"rejected": f"{name}_rejected", "malformed": f"{name}_malformed", **kw}
        ingest_stream.start(stream, f"{name}_sensor", name, f"{tmp_path}/{checkpoint}", trigger=ALL, **kw).awaitTermination()
        return rows(tables.fresh(spark, name).select("sensor_id", F.second("time"), "measurement"))

    return folder, run


def test_replay_and_resume(spark, world):
    folder, run = world
    put(spark, folder, [(1, 1, message(("A", 1, 1.0), ("B", 1, 2.0), ("A", 1, 9.0)))])
    put(spark, folder, [(2, 2, message(("A", 1, 5.0), ("A", 2, 3.0)))])
    want = [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 2.0)]
    assert run() == want
    # Resumed from the checkpoint: only the new file is read.
    put(spark, folder, [(3, 3, message(("B", 3, 4.0)))])
    want = sorted([*want, (2, 3, 4.0)], key=str)
    assert run() == want
    # Replayed from the first offset with a fresh checkpoint: nothing changes.
    assert run("c2") == want


def test_one_unknown_serial_rejects_its_message(spark, world, name):
    folder, run = world
    put(spark, folder, [(1, 1, message(("A", 1, 1.0), ("X", 2, 2.0), ("A", 3, 3.0))), (2, 2, message(("B", 1, 1.0))),
                        (3, 3, "broken")])
    got = run(stats=f"{name}_stats")
    assert got == [(2, 1, 1.0)]
    assert tables.fresh(spark, f"{name}_rejected").count() == 3
    assert rows(tables.fresh(spark, f"{name}_malformed").select("batch_id", "value")) == [(3, "broken")]
    assert rows(tables.fresh(spark, f"{name}_stats").select("batch_id", "serial_number", "status", "n")) == [
        ("1", "A", "error", 2), ("1", "X", "error", 1), ("2", "B", "success", 1)]


def test_quarantine_needs_its_tables(spark, name):
    with pytest.raises(ValueError):
        ingest_stream.start(None, f"{name}_sensor", name, "c", rejected=f"{name}_rejected")


def test_quarantine_keeps_the_known_readings(spark, world, name):
    folder, run = world
    put(spark, folder, [(1, 1, message(("A", 1, 1.0), ("X", 2, 2.0)))])
    assert run(mode="quarantine") == [(1, 1, 1.0)]
    assert rows(tables.fresh(spark, f"{name}_rejected").select("serial_number", "measurement")) == [("X", 2.0)]


def test_fail_policy_writes_nothing_and_recovers(spark, world, name):
    folder, run = world
    put(spark, folder, [(1, 1, message(("A", 1, 1.0), ("X", 2, 2.0)))])
    with pytest.raises(StreamingQueryException):
        run(on_bad="fail")
    assert spark.table(name).count() == 0
    # The sensor is registered; the repeated micro-batch sees it without a restart of anything else.
    spark.createDataFrame([(3, "X")], "id int, serial_number string").write.mode("append").insertInto(f"{name}_sensor")
    assert run(on_bad="fail") == [(1, 1, 1.0), (3, 2, 2.0)]


def test_late_rows_are_accepted_and_marked(spark):
    m = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:30:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("time"))
    got = ingest.late_flag(m, "2024-01-01 00:45:00", 30 * 60 * 10**6)
    assert sorted(r.late for r in got.collect()) == [False, True]


def test_registry_stream(spark, name, tmp_path):
    tables.create(spark.createDataFrame([(5, "A", 1.0, None)],
                                        "id int, serial_number string, sample_frequency double, target_id int"), name)
    put(spark, f"{tmp_path}/in", [
        (0, 1, '{"SerialNumber":"A","SampleFrequency":9.0}'), (0, 2, '{"SerialNumber":"B","SampleFrequency":2.0}'),
        (0, 3, '{"SerialNumber":"B","SampleFrequency":3.0}'), (0, 4, '{"SerialNumber":"C","SampleFrequency":-1}'),
        (0, 5, '{"SerialNumber":"D"}'), (0, 6, "{}")])
    stream = readers.file_stream(spark, f"{tmp_path}/in", "batch_id int, arrival int, value string")
    for c in ("c1", "c2"):
        registry.start(stream, name, f"{tmp_path}/{c}", f"{name}_{c}", trigger=ALL).awaitTermination()
        kept = [(r.reason, r.message) for r in tables.fresh(spark, f"{name}_{c}").collect()]
        assert sorted(k[0] for k in kept) == ["frequency_not_positive", "malformed"]
        assert any('"serial_number":"C"' in k[1] for k in kept)
    got = tables.fresh(spark, name)
    assert rows(got.select("serial_number", "sample_frequency")) == [("A", 1.0), ("B", 2.0), ("D", None)]
    assert len({r.id for r in got.collect()}) == 3


def test_log_stream_and_tail(spark, name, tmp_path):
    put(spark, f"{tmp_path}/in", [(0, 1, '{"SerialNumber":"AAD-1123","Timestamp":"2025-01-01T00:00:00.12Z","Level":"INFO",'
                                         '"Message":"sensor is set to \\"sleep\\""}'), (0, 2, "?")])
    put(spark, f"{tmp_path}/in", [(0, 3, "!")])
    stream = readers.file_stream(spark, f"{tmp_path}/in", "batch_id int, arrival int, value string", max_files=1)
    logs.start(stream, f"{tmp_path}/out", f"{tmp_path}/c", name, trigger=ALL).awaitTermination()
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").select("value").collect()] == [
        'time="2025-01-01T00:00:00.12Z" logger="AAD-1123" level="INFO" message="sensor is set to "sleep""']
    assert sorted(r.message for r in tables.fresh(spark, name).collect()) == [
        '{"batch_id":0,"arrival":2,"value":"?"}', '{"batch_id":0,"arrival":3,"value":"!"}']
    tail = decode.parse_log_lines(readers.log_file_stream(spark, f"{tmp_path}/out/*"))
    q = tail.writeStream.format("memory").queryName("tail").trigger(**ALL).start()
    q.awaitTermination()
    assert rows(spark.table("tail").select("logger", "level", "message")) == [("AAD-1123", "INFO", 'sensor is set to "sleep"')]


# Command sequences with the state and texts they lead to (fixed values).
HZ = 100.0
SEQUENCES = {
    "S1": ([("sleep", None)], (True, HZ), ["sensor is set to sleep"]),
    "S2": ([("sleep", None), ("sleep", None)], (True, HZ),
           ["sensor is set to sleep", "sensor is already in a sleep state"]),
    "S3": ([("awake", None)], (False, HZ), ["sensor is already in an awake state"]),
    "S4": ([("sleep", None), ("awake", None)], (False, HZ),
           ["sensor is set to sleep", "sensor is awake from sleep at 100 [Hz]"]),
    "S5": ([("changeSampleFrequency", "12.5")], (False, 12.5), ["Sample frequency changed to 12.5 [Hz]"]),
    "S6": ([("sleep", None), ("changeSampleFrequency", "1000")], (True, 1000.0),
           ["sensor is set to sleep", "Sample frequency changed to 1000 [Hz]",
            "changes of sample frequency applied, but sensor is currently in a sleep state"]),
    "S7": ([("changeSampleFrequency", None)], (False, HZ), ["SampleFrequency is not a number. Skipping..."]),
    "S8": ([("changeSampleFrequency", "fast")], (False, HZ), ["SampleFrequency is not a number. Skipping..."]),
    "S9": ([("login", None), ("sleep", None)], (True, HZ), ["not a valid command", "sensor is set to sleep"]),
    "S10": ([("changeSampleFrequency", "25000000"), ("sleep", None), ("awake", None)], (False, 25e6),
            ["Sample frequency changed to 25000000 [Hz]", "sensor is set to sleep",
             "sensor is awake from sleep at 25000000 [Hz]"]),
}


@pytest.fixture
def command_messages(spark, tmp_path):
    n, halves = 0, ([], [])
    for serial, (seq, _, _) in SEQUENCES.items():
        for i, (word, hz) in enumerate(seq):
            params = f',"Params":{{"sampleFrequency":"{hz}"}}' if hz else ""
            n += 1
            halves[i * 2 // max(len(seq), 2)].append(
                (0, n, f'{{"SerialNumber":"{serial}","Timestamp":"2024-01-0{i + 1}T00:00:00Z","Command":"{word}"{params}}}'))
    for half in halves:
        put(spark, f"{tmp_path}/in", half, "batch_id int, arrival bigint, value string")
    return f"{tmp_path}/in"


@pytest.fixture
def initial(spark):
    return spark.createDataFrame([(s, False, HZ) for s in SEQUENCES],
                                 "serial_number string, asleep boolean, sample_frequency double")


def test_command_fold(spark, command_messages, initial):
    parsed, _ = decode.commands(spark.read.parquet(command_messages))
    for block in (1, 7, 10_000):
        state, reports = ops.fold(parsed, initial, block=block)
        assert {r.serial_number: (r.asleep, r.sample_frequency) for r in state.collect()} == {
            s: v[1] for s, v in SEQUENCES.items()}
        texts = {}
        for r in reports.orderBy("time", "arrival", "seq").collect():
            texts.setdefault(r.serial_number, []).append(r.message)
        assert texts == {s: v[2] for s, v in SEQUENCES.items()}


def command_stream(spark, folder):
    parsed, _ = decode.commands(readers.file_stream(spark, folder, "batch_id int, arrival bigint, value string", max_files=1))
    return parsed


def reported(spark, folder):
    texts = {}
    for r in spark.read.parquet(f"{folder}/reports").orderBy("time", "arrival", "seq").collect():
        texts.setdefault(r.serial_number, []).append(r.message)
    return texts


def test_command_stream_equals_the_fold(spark, command_messages, initial, tmp_path):
    commands.start(command_stream(spark, command_messages), initial, f"{tmp_path}/out", f"{tmp_path}/c",
                   trigger=ALL).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/states").select(
        "serial_number", "arrival", "was_asleep", "was_hz", "asleep", "hz")
    batch, _ = decode.commands(spark.read.parquet(command_messages))
    want = ops.timeline(batch, initial).select(
        "serial_number", "arrival", "was_asleep", "was_hz", F.coalesce("sets_asleep", "was_asleep"),
        F.coalesce("sets_hz", "was_hz"))
    assert rows(got) == rows(want)
    assert reported(spark, f"{tmp_path}/out") == {s: v[2] for s, v in SEQUENCES.items()}


def test_folded_command_stream(spark, command_messages, initial, name, tmp_path):
    tables.create(spark.createDataFrame([], commands.STATE), name, ["epoch"])
    commands.start_folded(command_stream(spark, command_messages), initial, name, f"{tmp_path}/out", f"{tmp_path}/c",
                          trigger=ALL).awaitTermination()
    assert reported(spark, f"{tmp_path}/out") == {s: v[2] for s, v in SEQUENCES.items()}
    newest = tables.fresh(spark, name).where("epoch = 1")
    assert {r.serial_number: (r.asleep, r.sample_frequency) for r in newest.collect()} == {
        s: v[1] for s, v in SEQUENCES.items()}


@pytest.mark.parametrize("files", [1, 1000])
def test_commands_apply_in_arrival_order_whatever_the_cut(spark, tmp_path, name, files):
    """Times run against arrival; one file per micro-batch, or all at once."""
    words = ["sleep", "changeSampleFrequency", "awake", "awake", "sleep", "sleep"]
    for n, word in enumerate(words):
        params = f',"Params":{{"sampleFrequency":{n + 1}}}' if word.startswith("change") else ""
        put(spark, f"{tmp_path}/in", [(0, n, f'{{"SerialNumber":"A","Timestamp":"2024-01-{20 - n}T00:00:00Z","Command":"{word}"{params}}}')],
            "batch_id int, arrival bigint, value string")
    start = spark.createDataFrame([("A", False, HZ)], "serial_number string, asleep boolean, sample_frequency double")
    batch, _ = decode.commands(spark.read.parquet(f"{tmp_path}/in"))
    want = rows(ops.reports(ops.timeline(batch, start)).select("arrival", "seq", "message"))
    assert [r[2] for r in sorted(want)] == [
        "sensor is set to sleep", "Sample frequency changed to 2 [Hz]",
        "changes of sample frequency applied, but sensor is currently in a sleep state", "sensor is awake from sleep at 2 [Hz]",
        "sensor is already in an awake state", "sensor is set to sleep", "sensor is already in a sleep state"]

    def stream():
        return decode.commands(readers.file_stream(spark, f"{tmp_path}/in", "batch_id int, arrival bigint, value string", max_files=files))[0]
    commands.start(stream(), start, f"{tmp_path}/keyed", f"{tmp_path}/c1", trigger=ALL).awaitTermination()
    tables.create(spark.createDataFrame([], commands.STATE), name, ["epoch"])
    commands.start_folded(stream(), start, name, f"{tmp_path}/folded", f"{tmp_path}/c2", trigger=ALL).awaitTermination()
    for form in ("keyed", "folded"):
        assert rows(spark.read.parquet(f"{tmp_path}/{form}/reports").select("arrival", "seq", "message")) == want


def test_commands_from_message_files(spark, tmp_path, name):
    (tmp_path / "in").mkdir()
    for n, word in enumerate(("sleep", "awake")):
        (tmp_path / "in" / f"{n}.json").write_text(f'{{"SerialNumber":"A","Timestamp":"2024-01-01T00:00:00Z","Command":"{word}"}}')
        __import__("time").sleep(0.05)
    (tmp_path / "in" / "x.json").write_text("?")
    start = spark.createDataFrame([("A", False, HZ)], "serial_number string, asleep boolean, sample_frequency double")
    messages = readers.message_files(spark, f"{tmp_path}/in")
    commands.start(decode.commands(messages)[0], start, f"{tmp_path}/out", f"{tmp_path}/c", trigger=ALL).awaitTermination()
    assert [r.message for r in spark.read.parquet(f"{tmp_path}/out/reports").orderBy("arrival").collect()] == [
        "sensor is set to sleep", f"sensor is awake from sleep at {HZ:.0f} [Hz]"]
    quarantine.start(messages, decode.commands, name, f"{tmp_path}/q", trigger=ALL).awaitTermination()
    assert ['"value":"?"' in r.message for r in tables.fresh(spark, name).collect()] == [True]


FREQUENCIES = {"1e22": "1e+22", "1e-5": "1e-05", "0.00012": "0.00012", "100": "100", "1e20": "100000000000000000000", "12.50": "12.5",
               "1e-17": "1e-17", "123456789.125": "123456789.125", "0": "0", "-2.5": "-2.5", "1E3": "1000", "1.5e300": "1.5e+300"}


def test_frequencies_of_any_form(spark, initial):
    odd = ["10d", "7f", " 5 ", "Infinity", "NaN", "0x1p3", "1e999", "", ".5", "1.", "+1"]
    sent = [*FREQUENCIES, *odd]
    got = ops.reports(ops.timeline(spark.createDataFrame(
        [("S1", n, "changeSampleFrequency", {"sampleFrequency": hz}) for n, hz in enumerate(sent)],
        "serial_number string, arrival bigint, command string, params map<string,string>").withColumn("time", F.current_timestamp()), initial))
    texts = [r.message for r in got.orderBy("arrival").collect()]
    assert texts == [f"Sample frequency changed to {t} [Hz]" for t in FREQUENCIES.values()] + ["SampleFrequency is not a number. Skipping..."] * len(odd)


def test_packing_stream(spark, tmp_path):
    schema = "serial_number string, time timestamp, measurement double"
    # The second file is far ahead, the third is late: nothing is lost, and the period of A is sent again.
    data = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 2.0), ("A", 1, 3.0), ("B", 900, 4.0), ("A", 0, 5.0)],
                                 "serial_number string, s int, measurement double") \
        .select("serial_number", (F.timestamp_seconds(F.col("s") + 1704067200)).alias("time"), "measurement")
    for part in ("measurement <= 3", "measurement = 4", "measurement = 5"):
        data.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for files in (1, 1000):
        stream = readers.file_stream(spark, f"{tmp_path}/in", schema, max_files=files)
        packing.start(stream, f"{tmp_path}/out{files}", f"{tmp_path}/c{files}", trigger=ALL).awaitTermination()
        sent = spark.read.parquet(f"{tmp_path}/out{files}")
        back, bad = decode.measurements(sent.select("value"))
        assert bad.count() == 0
        assert rows(back.select("serial_number", "time", "measurement")) == rows(data)
        assert sent.agg(F.sum("n")).first()[0] == 5


def _readings(spark, folder, seconds):
    spark.createDataFrame([("A", s, 1.0) for s in seconds], "serial_number string, s bigint, measurement double").select(
        "serial_number", F.timestamp_seconds("s").alias("time"), "measurement").coalesce(1).write.mode("append").parquet(folder)


RESENT = "serial_number string, time timestamp, measurement double"
MONTH, NOW = 30 * 86400, 1704067200


def test_resent_readings_are_dropped_in_the_stream(spark, tmp_path):
    """A reading a month behind the newest is not late, and its copy is dropped."""
    for seconds in (range(NOW, NOW + 5), [*range(NOW - MONTH, NOW - MONTH + 3), NOW], range(NOW - MONTH, NOW + 5 - MONTH), [NOW + 1]):
        _readings(spark, f"{tmp_path}/in", seconds)
    out = ingest_stream.drop_resent(readers.file_stream(spark, f"{tmp_path}/in", RESENT, max_files=1), "35 minutes")
    q = out.writeStream.format("memory").queryName("resent").trigger(**ALL).start()
    q.awaitTermination()
    assert sorted(r.time.timestamp() for r in spark.table("resent").collect()) == [
        *range(NOW - MONTH, NOW - MONTH + 5), *range(NOW, NOW + 5)]


def test_state_of_resent_readings_ends_with_their_time_to_live(spark, tmp_path):
    """Keys leave the state by arrival: those of the first run are gone when the third has run."""
    def run(seconds):
        _readings(spark, f"{tmp_path}/in", seconds)
        out = ingest_stream.drop_resent(readers.file_stream(spark, f"{tmp_path}/in", RESENT, max_files=1), "2 seconds")
        q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(**ALL).start())
        q.awaitTermination()
        return q.lastProgress.stateOperators[0].numRowsTotal

    assert run(range(NOW, NOW + 50)) in (0, 50)
    for k in range(2):
        time.sleep(3)
        left = run([NOW + 100 + k])
    assert left <= 2
    assert spark.read.schema(RESENT).parquet(f"{tmp_path}/out").count() == 52


def test_a_message_waits_for_its_sensor(spark, world, name):
    folder, run = world
    kw = dict(retry=f"{name}_retry", attempts=3, stats=f"{name}_stats")
    put(spark, folder, [(1, 1, message(("A", 1, 1.0), ("C", 2, 2.0))), (2, 2, message(("X", 1, 1.0))), (3, 3, message(("B", 1, 1.0)))])
    assert run(**kw) == [(2, 1, 1.0)]
    waiting = tables.fresh(spark, f"{name}_retry")
    assert rows(waiting.select("batch_id", "attempt", "epoch")) == [(1, 1, 0), (2, 1, 0)]
    assert tables.fresh(spark, f"{name}_rejected").count() == 0
    spark.createDataFrame([(3, "C")], "id int, serial_number string").write.mode("append").insertInto(f"{name}_sensor")
    put(spark, folder, [(4, 4, message(("A", 5, 5.0)))])
    want = [(1, 1, 1.0), (1, 5, 5.0), (2, 1, 1.0), (3, 2, 2.0)]
    assert run(**kw) == want
    # The third attempt is the last; then nothing waits.
    for k in (5, 6):
        put(spark, folder, [(k, k, message(("A", 5, 5.0)))])
        assert run(**kw) == want
    assert rows(tables.fresh(spark, f"{name}_rejected").select("batch_id", "serial_number")) == [(2, "X")]
    assert rows(tables.fresh(spark, f"{name}_retry").where("epoch >= 2").select("batch_id")) == []
    tried = tables.fresh(spark, f"{name}_stats").where("status = 'error'").groupBy("batch_id").agg(F.countDistinct("epoch"))
    assert rows(tried) == [("1", 1), ("2", 3)]


def test_maintenance_between_micro_batches_loses_nothing(spark, world, name):
    from tidewire.plans import jobs
    from tidewire.sources import catalog
    from tidewire.streaming import progress

    folder, run = world
    catalog.create(spark, name)
    for k in range(3):  # every file has readings for every chunk: late ones after the first
        put(spark, folder, [(k, k, message(*[("AB"[i % 2], 20 * k + i, float(i)) for i in range(6)]))])
    listener = progress.ProcessingTimes()
    spark.streams.addListener(listener)
    try:
        got = run(maintain_every=1, maintenance=lambda s: jobs.maintain_measurements(s, name, "2024-01-01 00:30:00"))
    finally:
        spark.streams.removeListener(listener)
    assert got == sorted([(1 + i % 2, 20 * k + i, float(i)) for k in range(3) for i in range(6)], key=str)
    assert all(r.compacted for r in catalog.chunks(spark, name).collect())
    times = listener.frame(spark)
    assert times.count() == 3 and times.where("seconds > 0").count() == 3
    last = progress.histogram(times).where(F.col("le") == float("inf")).collect()
    assert [r.bucket_count for r in last] == [3]


def test_waiting_messages_are_written_last(spark, world, name, monkeypatch):
    """A write to the table of waiting messages makes Spark forget the readings that were parsed from it."""
    folder, run = world
    done = []
    for module, what in ((ingest_stream, "append_epoch"), (ingest_stream.tables, "write_measurements"), (ingest_stream.epochs, "append")):
        def told(*args, _call=getattr(module, what), _what=what, **kw):
            done.append(_what)
            return _call(*args, **kw)
        monkeypatch.setattr(module, what, told)
    kw = dict(retry=f"{name}_retry", attempts=3, stats=f"{name}_stats")
    put(spark, folder, [(1, 1, message(("C", 2, 2.0))), (2, 2, message(("B", 1, 1.0)))])
    assert run(**kw) == [(2, 1, 1.0)]
    assert done == ["append", "append", "write_measurements", "append", "append_epoch"]
    put(spark, folder, [(3, 3, message(("A", 1, 1.0)))])
    assert run(**kw) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert done[5:] == done[:5]
    assert rows(tables.fresh(spark, f"{name}_retry").select("batch_id", "attempt", "epoch")) == [(1, 1, 0), (1, 2, 1)]
