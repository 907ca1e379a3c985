"""Commands of one sensor sorted in bounded memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import commands as ops
from tidewire.streaming import commands


class Store(dict):
    """A map state; counts the pages it holds at most."""

    most = 0

    def updateValue(self, key, value):
        assert key not in self
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


@pytest.mark.parametrize("rows, memory, page, fan", [
    (0, 10, 3, 2), (1, 10, 3, 2), (10, 10, 3, 2), (11, 10, 3, 2), (500, 10, 3, 2), (2000, 50, 7, 3), (2000, 50, 1000, 3), (200, 1, 1, 2)])
@pytest.mark.parametrize("values", [10, 1_000_000])
def test_equals_a_stable_sort(rows, memory, page, fan, values):
    random = np.random.default_rng(rows + values)
    frame = pd.DataFrame({"arrival": random.integers(0, values, rows), "n": np.arange(rows)})
    store = Store()
    runs = commands.SortedRuns(store, "arrival", memory, page, fan)
    for start in range(0, rows, 37):
        runs.add(frame.iloc[start:start + 37])
        assert sum(map(len, runs._held)) <= memory
        assert all(len(level) < fan for level in runs._levels)
    most = memory + page * (fan - 1) * len(runs._levels)
    pieces = list(runs.pages())
    assert all(len(p) <= most for p in pieces)
    got = pd.concat(pieces) if pieces else frame
    assert got.values.tolist() == frame.sort_values("arrival", kind="stable").values.tolist()
    assert not store and (rows > memory) == (store.most > 0)


def test_one_sensor_with_most_commands_of_a_micro_batch(spark, tmp_path, name):
    """3000 commands of one sensor in one micro-batch, in no order, sorted with 400 in memory; then 200 more on its state."""
    words = F.element_at(F.array(*[F.lit(w) for w in ("sleep", "awake", "changeSampleFrequency", "delete")]),
                         (F.pmod(F.xxhash64("arrival"), F.lit(4)) + 1).cast("int"))
    made = spark.range(3200).select(
        F.when(F.col("id") % 16 == 0, F.lit("B")).otherwise(F.lit("A")).alias("serial_number"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("time"), F.col("id").alias("arrival"))
    made = made.withColumn("command", words).withColumn("params", F.create_map(F.lit("sampleFrequency"), F.col("arrival").cast("string")))
    for part in (F.col("arrival") < 3000, F.col("arrival") >= 3000):
        made.where(part).orderBy(F.xxhash64("arrival")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = spark.createDataFrame([("A", False, 100.0), ("B", True, 7.0)], "serial_number string, asleep boolean, sample_frequency double")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    states = commands.states(stream, start, commands.SensorFold(memory=400, page=60, fan=3))
    (states.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
     .trigger(availableNow=True).start().awaitTermination())
    columns = ["serial_number", "arrival", "was_asleep", "was_hz"]
    want = ops.timeline(made, start).select(*columns)
    got = spark.table(name).select(*columns)
    assert got.count() == 3200 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
