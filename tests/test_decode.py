from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.functions.timing import bucket, bucket_ceil, instant, rfc3339, window_start
from tidewire.operators import decode

# Published cases of the serial rule, and more edges.
SERIALS = {
    "AAD-123": True, "AAD12313": True, "AAD123130": False, "----": False, "<AAD-123>": False,
    "$AA'-1`3>": False, "AAD\n": False, "ñandúé-1": False, "A½Ⅷ": True, "": False, "é": True, "123": False,
}


def test_serials(spark):
    df = spark.createDataFrame([(s,) for s in SERIALS], "s string")
    got = {r.s: r.ok for r in df.select("s", text.validate_serial(F.col("s")).alias("ok")).collect()}
    assert got == SERIALS


@pytest.mark.parametrize("pattern,topic,want", [
    ("sensor.*.logs.#", "sensor.a.logs", True),
    ("sensor.*.logs.#", "sensor.a.logs.x.y", True),
    ("sensor.*.logs.#", "sensor.a.b.logs", False),
    ("sensor.*.logs.#", "sensor..logs", False),
    ("sensor.*.logs.#", "sensor.a.logsx", False),
    ("sensor.*.logs.#", "xsensor.a.logs", False),
    ("sensor.*.logs.#", "sensor.a.logs\n", False),
    ("sensor.AAD-1.commands.#", "sensor.AAD-1.commands.sleep", True),
    ("sensor.AAD-1.commands.#", "sensor.AAD-2.commands.sleep", False),
    ("#", "a.b", True), ("#", "", True), ("#.logs", "a.logs", True),
])
def test_topics(spark, pattern, topic, want):
    df = spark.createDataFrame([(topic,)], "topic string")
    assert df.select(text.topic_matches(F.col("topic"), pattern)).first()[0] is want


def test_fan_out(spark):
    df = spark.createDataFrame([("sensor.a.logs",), ("sensor.a.measurements",), ("sensor.a.registry.created",)],
                               "topic string")
    assert {n: decode.route(df, n).count() for n in decode.ROUTES} == {
        "logs": 1, "measurements": 1, "registry": 1, "commands": 0}


MESSAGES = [
    (1, '[{"SerialNumber":"A","Timestamp":"2025-01-07T11:32:18.123456789Z","Value":1.5}]'),
    (2, '[{"SerialNumber":"A","Timestamp":"2025-01-07T08:32:18.5-03:00","Value":2},'
        '{"SerialNumber":"B","Timestamp":"2025-01-07T11:32:19Z","Value":-3.25}]'),
    (3, "[]"),
    (4, "not json"),
    (5, '[{"SerialNumber":"A","Timestamp":"2025-01-07T11:32:18Z"}]'),
    (6, '[{"serialnumber":"A","Timestamp":"2025-01-07T11:32:18Z","Value":1}]'),
    (7, '[{"SerialNumber":"A","Timestamp":"2025-01-07T11:32:18Z","Value":1},{"SerialNumber":"B"}]'),
    (8, '[{"SerialNumber":"A","Timestamp":"yesterday","Value":1}]'),
    (9, None),
    (10, '{"SerialNumber":"A","Timestamp":"2025-01-07T11:32:18Z","Value":1}'),
    (11, '[{"SerialNumber":"A","Timestamp":"2025-01-07T11:32:18Z","Value":1}] and more'),
    (12, ' [ {"Value":7,"Timestamp":"2025-01-07T11:32:18Z",\n"SerialNumber":"A"} ]\n'),
]


def test_measurements(spark):
    raw = spark.createDataFrame(MESSAGES, "batch_id int, value string")
    good, bad = decode.measurements(raw)
    got = [(r.batch_id, r.pos, r.serial_number, r.t, r.measurement) for r in good.select(
        "*", F.col("time").cast("string").alias("t")).orderBy("batch_id", "pos").collect()]
    assert got == [
        (1, 0, "A", "2025-01-07 11:32:18.123456", 1.5),
        (2, 0, "A", "2025-01-07 11:32:18.5", 2.0),
        (2, 1, "B", "2025-01-07 11:32:19", -3.25),
        (12, 0, "A", "2025-01-07 11:32:18", 7.0),
    ]
    assert sorted(r.batch_id for r in bad.collect()) == [4, 5, 6, 7, 8, 9, 10, 11]


def test_a_message_is_parsed_once(spark):
    raw = spark.createDataFrame(MESSAGES, "batch_id int, value string")
    plan = decode.measurements(raw)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_message_sizes(spark):
    raw = spark.createDataFrame(MESSAGES, "batch_id int, value string")
    got = {r.batch_id: r.batch_size for r in decode.message_sizes(raw).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 0, 5: 1, 6: 1, 7: 2, 8: 1, 9: 0, 10: 0, 11: 0, 12: 1}


def test_commands_keep_their_parameters(spark):
    raw = spark.createDataFrame([
        ('{"SerialNumber":"A","Timestamp":"2025-01-01T00:00:00Z","Command":"changeSampleFrequency",'
         '"Params":{"sampleFrequency":"1000"}}',),
        ('{"SerialNumber":"A","Timestamp":"2025-01-01T00:00:00Z","Command":"sleep"}',), ("[1]",),
        ('[{"SerialNumber":"A","Timestamp":"2025-01-01T00:00:00Z","Command":"sleep"}]',)], "value string")
    good, bad = decode.commands(raw)
    assert sorted((r.command, (r.params or {}).get("sampleFrequency")) for r in good.collect()) == [
        ("changeSampleFrequency", "1000"), ("sleep", None)]
    assert bad.count() == 2


def test_unnest_pads_the_shorter_array(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a"])], "id int, x array<int>, y array<string>")
    assert rows(decode.unnest_arrays(df, ["x", "y"])) == [(1, 1, "a"), (1, 2, None)]


@pytest.mark.parametrize("stamp,want", [
    ("2025-01-01 00:00:00.12", "2025-01-01T00:00:00.12Z"),
    ("2025-01-01 00:00:00", "2025-01-01T00:00:00Z"),
    ("2025-01-01 10:20:30.000001", "2025-01-01T10:20:30.000001Z"),
])
def test_rfc3339(spark, stamp, want):
    assert spark.range(1).select(rfc3339(F.lit(stamp).cast("timestamp"))).first()[0] == want


def test_log_lines(spark):
    df = spark.createDataFrame([("AAD-1123", "INFO", "sensor is set to sleep")],
                               "serial_number string, level string, message string") \
        .withColumn("time", F.lit("2025-01-01 00:00:00.12").cast("timestamp"))
    lines = decode.log_lines(df)
    assert lines.first().value == \
        'time="2025-01-01T00:00:00.12Z" logger="AAD-1123" level="INFO" message="sensor is set to sleep"'
    back = decode.parse_log_lines(lines).first()
    assert (back.logger, back.level, back.message) == ("AAD-1123", "INFO", "sensor is set to sleep")
    # The writer does not escape quotes; the message is the last field and ends at the last quote.
    quoted = decode.parse_log_lines(decode.log_lines(df.withColumn("message", F.lit('a "b" c')))).first()
    assert quoted.message == 'a "b" c'


def test_pack_and_decode_are_inverse(spark):
    m = spark.createDataFrame([("A", 1, 0.5), ("A", 1, 0.25), ("A", 2, 1.0), ("B", 1, 3.0)], "s string, t int, v double") \
        .select(F.col("s").alias("serial_number"),
                F.expr("timestamp_micros(1704067200000000 + t * 1000000L + cast(v * 100 as bigint))").alias("time"),
                F.col("v").alias("measurement"))
    packed = decode.pack(m)
    assert sorted(r.n for r in packed.collect()) == [1, 1, 2]
    back, bad = decode.measurements(packed.select("value"))
    assert bad.count() == 0
    assert rows(back.select("serial_number", "time", "measurement")) == rows(m)


def test_constraints(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None), ("C", 0.0), ("D", -1.0), (None, 1.0), ("x" * 21, 1.0)],
                               "serial_number string, sample_frequency double")
    good, bad = decode.split_valid(df, decode.SENSOR_RULES)
    assert rows(good.select("serial_number")) == [("A",), ("B",)]
    assert sorted(v for r in bad.collect() for v in r.violations) == [
        "frequency_not_positive", "frequency_not_positive", "serial_missing", "serial_too_long"]


def test_buckets(spark):
    def at(s, w, f=bucket):
        return str(spark.range(1).select(f(instant(s), w).cast("string")).first()[0])

    assert at("2024-01-04 13:07:00", "5 minutes") == "2024-01-04 13:05:00"
    assert at("2024-01-04 13:07:00", "1 week") == "2024-01-01 00:00:00"
    assert at("2024-01-04 13:07:00", "7 days") == "2024-01-01 00:00:00"
    assert at("1969-12-31 23:59:59", "1 hour") == "1969-12-31 23:00:00"
    assert at("2024-01-04 13:07:00", "5 minutes", bucket_ceil) == "2024-01-04 13:10:00"
    assert at("2024-01-04 13:05:00", "5 minutes", bucket_ceil) == "2024-01-04 13:05:00"
    for w in ("5 minutes", "7 minutes", "1 week", "13 seconds"):
        df = spark.range(0, 10**9, 12345677).select(F.timestamp_seconds("id").alias("t"))
        a = df.select(bucket("t", w).alias("b")).collect()
        b = df.select(window_start("t", w).alias("b")).collect()
        assert a == b
    assert datetime(2024, 1, 1).weekday() == 0


def test_size_pretty(spark):
    # Fixed values.
    want = {0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 1048576: "1024 kB", 10485247: "10239 kB",
            10485248: "10 MB", 1073741824: "1024 MB", 11 * 2**30: "11 GB", 12 * 2**50: "12 PB"}
    df = spark.createDataFrame([(k,) for k in want], "v bigint")
    assert {r.v: r.t for r in df.select("v", text.size_pretty(F.col("v")).alias("t")).collect()} == want
