"""From raw messages to typed rows and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.timing import bucket, rfc3339

#: Microsecond precision; the JSON writer's own default would cut to milliseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# Topic patterns of the consumers.
ROUTES = {
    "logs": "sensor.*.logs.#",
    "measurements": "sensor.*.measurements.#",
    "registry": "sensor.*.registry.#",
    "commands": "sensor.*.commands.#",
}


def route(messages: DataFrame, name: str, topic: str = "topic") -> DataFrame:
    """The messages one consumer is bound to."""
    return messages.where(text.topic_matches(F.col(topic), ROUTES[name]))


def matched_routes(topic: Column) -> Column:
    """Names of all consumers a topic reaches, in a fixed order."""
    hits = [F.when(text.topic_matches(topic, p), F.lit(n)) for n, p in sorted(ROUTES.items())]
    return F.array_compact(F.array(*hits))


# The JSON reader takes an object for an array of one, and ignores what follows a value.
_ARRAY, _OBJECT = r"(?s)\A\s*\[.*\]\s*\z", r"(?s)\A\s*\{.*\}\s*\z"


def _parsed(raw: DataFrame, schema: str, value: str) -> DataFrame:
    """The messages with ``__msg``, NULL where the text is no JSON of the schema's shape."""
    shape = _ARRAY if schema.startswith("array") else _OBJECT
    msg = F.when(F.col(value).rlike(shape), F.from_json(value, schema))
    # Wrapped in a generator, the parse stays one step of its own. As a plain column it would be copied
    # into every condition and field that uses it, and each message parsed several times.
    return raw.select("*", F.explode(F.array(msg)).alias("__msg"))


def measurements(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(readings, malformed messages).

    Readings keep the message's own columns plus ``pos``, the place in the array, so that the arrival
    order of a replayed message is the same again. A message is malformed when it is no JSON array of
    readings or when one of its readings misses a serial, time or value.
    """
    parsed = _parsed(raw, schemas.MEASUREMENT_PAYLOAD, value)
    broken = F.col("__msg").isNull() | F.exists(
        "__msg",
        lambda r: r.isNull() | r["SerialNumber"].isNull() | r["Timestamp"].isNull() | r["Value"].isNull(),
    )
    rest = [c for c in raw.columns if c != value]
    good = parsed.where(~broken).select(*rest, F.posexplode("__msg").alias("pos", "__r"))
    rows = good.select(
        *rest, "pos",
        F.col("__r.SerialNumber").alias("serial_number"),
        F.col("__r.Timestamp").alias("time"),
        F.col("__r.Value").alias("measurement"),
    )
    return rows, parsed.where(broken).drop("__msg")


def message_sizes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Readings per message; an undecodable message was received too and counts 0."""
    return _parsed(raw, schemas.MEASUREMENT_PAYLOAD, value).select(
        *[c for c in raw.columns if c != value], F.coalesce(F.size("__msg"), F.lit(0)).alias("batch_size"))


def _single(raw: DataFrame, schema: str, value: str, required: Sequence[str],
            fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed(raw, schema, value)
    broken = F.col("__msg").isNull()
    for name in required:
        broken = broken | F.col(f"__msg.{name}").isNull()
    rest = [c for c in raw.columns if c != value]
    rows = parsed.where(~broken).select(*rest, *[F.col(f"__msg.{k}").alias(v) for k, v in fields.items()])
    return rows, parsed.where(broken).drop("__msg")


def registrations(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    return _single(raw, schemas.REGISTRATION_PAYLOAD, value, ["SerialNumber"],
                   {"SerialNumber": "serial_number", "SampleFrequency": "sample_frequency"})


def commands(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    return _single(raw, schemas.COMMAND_PAYLOAD, value, ["SerialNumber", "Timestamp"],
                   {"SerialNumber": "serial_number", "Timestamp": "time", "Command": "command",
                    "Params": "params"})


def logs(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    return _single(raw, schemas.LOG_PAYLOAD, value, ["SerialNumber", "Timestamp"],
                   {"SerialNumber": "serial_number", "Timestamp": "time", "Level": "level",
                    "Message": "message"})


def unnest_arrays(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows from parallel arrays; a shorter array is padded with NULL."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.arrays_zip(*cols)))


def pack(m: DataFrame, period: str = "1 second", serial: str = "serial_number") -> DataFrame:
    """One JSON array of readings per sensor and period, oldest first.

    A group holds what one sensor measures in one period, which its sample frequency bounds.
    """
    reading = F.struct(
        F.col("time").alias("Timestamp"), F.col(serial).alias("SerialNumber"),
        F.col("measurement").alias("Value"),
    )
    packed = m.groupBy(serial, bucket("time", period).alias("period_start")).agg(
        F.sort_array(F.collect_list(reading)).alias("__readings")
    )
    return packed.select(
        serial, "period_start", F.size("__readings").alias("n"),
        F.to_json("__readings", JSON_OPTIONS).alias("value"),
    )


def log_lines(logs_: DataFrame) -> DataFrame:
    """Text lines of log records."""
    return logs_.select(
        text.logfmt_line(rfc3339("time"), F.col("serial_number"), F.col("level"), F.col("message")).alias("value")
    )


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields of text lines; logger and level are the labels logs are searched by."""
    line = F.col(value)
    return lines.select(
        F.try_to_timestamp(text.logfmt_field(line, "time")).alias("time"),
        *[text.logfmt_field(line, f).alias(f) for f in ("logger", "level")],
        text.logfmt_last_field(line, "message").alias("message"),
    )


# ---- row rules ------------------------------------------------------------------------------------

#: Rules of the stored tables as (name, SQL predicate that a valid row does not fail). Fixed values.
SENSOR_RULES = {
    "serial_missing": "serial_number IS NOT NULL",
    "serial_too_long": "char_length(serial_number) <= 20",
    "frequency_not_positive": "sample_frequency > 0.0",
}
TARGET_RULES = {"name_too_long": "char_length(name) <= 50"}
MEASUREMENT_RULES = {
    "time_missing": "time IS NOT NULL",
    "sensor_missing": "sensor_id IS NOT NULL",
    "measurement_missing": "measurement IS NOT NULL",
}


def violations(rules: Mapping[str, str]) -> Column:
    """Names of the failed rules. As in a CHECK constraint, an unknown result passes."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(True)), F.lit(n)) for n, p in rules.items()])
    )


def split_valid(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, the others with a ``violations`` column)."""
    checked = df.withColumn("violations", violations(rules))
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)
