"""Readings of a stream packed into one message per sensor and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode
from ..session import configure


def start(readings: DataFrame, folder: str, checkpoint: str, period: str = "1 second", trigger: dict | None = None
          ) -> StreamingQuery:
    """Write the messages below `folder`, one folder per micro-batch, which a repeated micro-batch replaces.

    A message holds what a micro-batch has of one sensor and period. Readings of a period that come later, however
    late, make a further message of it: there is no watermark, and every reading is sent exactly once.
    """
    def handle(micro: DataFrame, epoch: int) -> None:
        configure(micro.sparkSession)
        packed = decode.pack(micro, period).withColumn("period_start", F.col("period_start").cast("timestamp"))
        packed.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    writer = readings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
