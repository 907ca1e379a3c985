"""How long micro-batches take, as Spark itself reports it."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import metrics

SCHEMA = "query string, epoch bigint, time string, seconds double"


class ProcessingTimes(StreamingQueryListener):
    """Listens to a session's queries and keeps the time each micro-batch spent on its data, of the last `keep` micro-batches.

    Registered with ``spark.streams.addListener``; planning, offsets and commit are not counted.
    """

    def __init__(self, keep: int = 100_000):
        self._rows: deque[tuple] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if "addBatch" in p.durationMs:
            self._rows.append((p.name or str(p.id), p.batchId, p.timestamp, p.durationMs["addBatch"] / 1000.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per micro-batch: query, epoch, time, seconds."""
        return spark.createDataFrame(list(self._rows), SCHEMA).withColumn("time", F.col("time").cast("timestamp"))


def histogram(times: DataFrame, labels=("query",)) -> DataFrame:
    """Cumulative histogram of processing seconds over the declared buckets."""
    return metrics.histogram(times, "seconds", metrics.exponential_bounds(*metrics.PROCESSING_SECONDS_BUCKETS), labels)
