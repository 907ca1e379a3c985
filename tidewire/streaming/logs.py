"""Sensor logs to text lines, and text lines to searchable fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode
from ..session import configure
from . import quarantine


def start(messages: DataFrame, folder: str, checkpoint: str, malformed: str, trigger: dict | None = None) -> StreamingQuery:
    """Write one line per log record below `folder`, one folder per micro-batch, which a repeated micro-batch
    replaces. Messages that cannot be decoded go to the table `malformed`."""
    def handle(micro: DataFrame, epoch: int) -> None:
        configure(micro.sparkSession)
        rows, broken = decode.logs(micro)
        decode.log_lines(rows).write.mode("overwrite").text(f"{folder}/epoch={epoch}")
        quarantine.keep(broken, "malformed", malformed, epoch)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
