"""Registration messages to the sensor registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode, registry
from ..session import configure
from ..sources import epochs, tables


def start(messages: DataFrame, sensor_table: str, checkpoint: str, rejected: str, arrival: Sequence[str] = ("arrival",),
          trigger: dict | None = None) -> StreamingQuery:
    """Insert sensors the registry lacks; known ones keep their frequency. One writer assigns the ids.

    Messages that cannot be decoded, and sensors that break a rule of the table, go to the table `rejected`.
    """

    def handle(micro: DataFrame, epoch: int) -> None:
        spark = configure(micro.sparkSession)
        rows, malformed = decode.registrations(micro)
        rows, invalid = decode.split_valid(rows, decode.SENSOR_RULES)
        both = malformed.select(F.lit("malformed").alias("reason"), F.to_json(F.struct("*")).alias("message")).unionByName(
            invalid.select(F.concat_ws(",", "violations").alias("reason"),
                           F.to_json(F.struct(*[c for c in invalid.columns if c != "violations"])).alias("message")))
        epochs.append(both, rejected, epoch)
        sensor = tables.fresh(spark, sensor_table)
        new = registry.insert_missing(rows, sensor, "serial_number", arrival)
        for c in sensor.columns:
            if c not in new.columns:
                new = new.withColumn(c, F.lit(None).cast(sensor.schema[c].dataType))
        new.select(*sensor.columns).write.mode("append").insertInto(sensor_table)

    return (
        messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
