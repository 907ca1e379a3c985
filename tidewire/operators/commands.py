"""Sensor commands: what a sensor's state is after each one and what it reports.

A sensor acts on commands as they arrive, whatever time they carry. ``arrival`` is a number that grows along a sensor's
messages, so the result is the same for a table, and for a stream cut into any micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import frequency_text, number
from .scan import carry_forward_by_block

# Command words and report texts.
SLEEP, AWAKE, CHANGE_FREQUENCY = "sleep", "awake", "changeSampleFrequency"
VALID_COMMANDS = ["login", "logout", SLEEP, AWAKE, CHANGE_FREQUENCY, "delete"]
DEVICE_COMMANDS = [SLEEP, AWAKE, CHANGE_FREQUENCY]
FREQUENCY_PARAM = "sampleFrequency"
INFO, WARNING = "INFO", "WARNING"
TEXT = {
    "asleep_now": "sensor is set to sleep",
    "asleep_already": "sensor is already in a sleep state",
    "awake_now": "sensor is awake from sleep at %s [Hz]",
    "awake_already": "sensor is already in an awake state",
    "changed": "Sample frequency changed to %s [Hz]",
    "changed_asleep": "changes of sample frequency applied, but sensor is currently in a sleep state",
    "no_number": "SampleFrequency is not a number. Skipping...",
    "invalid": "not a valid command",
}


def classify(commands: DataFrame) -> DataFrame:
    """Adds ``known`` (a word of the command set) and ``accepted`` (a word the device acts on)."""
    return commands.withColumn("known", F.col("command").isin(VALID_COMMANDS)) \
        .withColumn("accepted", F.col("command").isin(DEVICE_COMMANDS))


def effects(commands: DataFrame) -> DataFrame:
    """Adds the asleep flag and the frequency a command sets, NULL where it sets none."""
    word = F.col("command")
    frequency = number(F.col("params")[FREQUENCY_PARAM])
    return commands.select(
        "*",
        F.when(word == SLEEP, True).when(word == AWAKE, False).alias("sets_asleep"),
        F.when(word == CHANGE_FREQUENCY, frequency).alias("sets_hz"),
    )


#: Arrival numbers whose commands are ordered in one group.
BLOCK = 100_000


def timeline(commands: DataFrame, initial: DataFrame, arrival: str = "arrival", block: int = BLOCK) -> DataFrame:
    """Every command (serial_number, time, arrival, command and what it sets) with the state before it.

    `initial` is (serial_number, asleep, sample_frequency): the state the fold starts from. Commands of a
    sensor are applied in the order of arrival.
    """
    kept = ["serial_number", "time", arrival, "command", "sets_asleep", "sets_hz"]
    rows = carry_forward_by_block(effects(commands).select(*kept), ["serial_number"], arrival, ["sets_asleep", "sets_hz"], block)
    start = initial.select("serial_number", F.col("asleep").alias("__asleep"),
                           F.col("sample_frequency").alias("__hz"))
    return rows.join(start, "serial_number", "left").select(
        *kept,
        F.coalesce("last_sets_asleep", "__asleep", F.lit(False)).alias("was_asleep"),
        F.coalesce("last_sets_hz", "__hz").alias("was_hz"),
    )


def reports(timeline_: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The log records the commands cause, one or two per command, numbered by ``seq``."""
    word, was_asleep = F.col("command"), F.col("was_asleep")

    def record(level: str, text):
        return F.struct(F.lit(level).alias("level"), (F.lit(text) if isinstance(text, str) else text).alias("message"))

    def with_hz(text: str, hz: str):
        return F.format_string(text, F.coalesce(frequency_text(F.col(hz)), F.lit("null")))

    changed = record(INFO, with_hz(TEXT["changed"], "sets_hz"))
    records = (
        F.when((word == SLEEP) & was_asleep, F.array(record(INFO, TEXT["asleep_already"])))
        .when(word == SLEEP, F.array(record(INFO, TEXT["asleep_now"])))
        .when((word == AWAKE) & was_asleep, F.array(record(INFO, with_hz(TEXT["awake_now"], "was_hz"))))
        .when(word == AWAKE, F.array(record(INFO, TEXT["awake_already"])))
        .when((word == CHANGE_FREQUENCY) & F.col("sets_hz").isNull(), F.array(record(WARNING, TEXT["no_number"])))
        .when((word == CHANGE_FREQUENCY) & was_asleep, F.array(changed, record(INFO, TEXT["changed_asleep"])))
        .when(word == CHANGE_FREQUENCY, F.array(changed))
        .otherwise(F.array(record(WARNING, TEXT["invalid"])))
    )
    return timeline_.select("serial_number", "time", arrival, F.posexplode(records).alias("seq", "__r")).select(
        "serial_number", "time", arrival, "seq", "__r.level", "__r.message")


def final_state(commands: DataFrame, initial: DataFrame, arrival: str = "arrival") -> DataFrame:
    """State per sensor after its commands: an aggregate, no ordering of rows needed."""
    latest = effects(commands).groupBy("serial_number").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in ("sets_asleep", "sets_hz")]
    )
    return latest.join(initial.select("serial_number", "asleep", "sample_frequency"), "serial_number", "left").select(
        "serial_number",
        F.coalesce("sets_asleep", "asleep", F.lit(False)).alias("asleep"),
        F.coalesce("sets_hz", "sample_frequency").alias("sample_frequency"),
    )


def fold(commands: DataFrame, initial: DataFrame, arrival: str = "arrival", block: int = BLOCK
         ) -> tuple[DataFrame, DataFrame]:
    """(state per sensor, log records)."""
    return final_state(commands, initial, arrival), reports(timeline(commands, initial, arrival, block), arrival)
