"""Messages a consumer cannot use, kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import configure
from ..sources import epochs


def keep(messages: DataFrame, reason: str, table: str, epoch: int) -> None:
    """Append the messages, as JSON of all their columns, under a reason, replacing an interrupted attempt's."""
    rows = messages.select(F.lit(reason).alias("reason"), F.to_json(F.struct("*")).alias("message"))
    epochs.append(rows, table, epoch)


def start(messages: DataFrame, decode: Callable[[DataFrame], tuple[DataFrame, DataFrame]], table: str, checkpoint: str,
          trigger: dict | None = None) -> StreamingQuery:
    """Write the messages that `decode` gives back as malformed to `table`: beside a consumer that keeps state in the
    stream and so can have one output only."""
    def handle(micro: DataFrame, epoch: int) -> None:
        configure(micro.sparkSession)
        keep(decode(micro)[1], "malformed", table, epoch)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
