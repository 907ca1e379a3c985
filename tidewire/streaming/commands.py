"""Sensor state as a stream.

Two forms with the same result. `start` keeps the state per sensor in Spark's state store; one task applies a sensor's
commands of a micro-batch, in bounded memory. A sensor's arrival numbers must grow from micro-batch to micro-batch, as those
of the package's sources do. `start_folded` folds a micro-batch with column expressions and keeps the
state in a table; no task sees all commands of a sensor, so one sensor may send most of them.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import commands as ops
from ..operators import ingest
from ..session import ROCKSDB_PROVIDER, configure
from ..sources import tables

# The processor travels to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = ("serial_number string, time timestamp, arrival bigint, command string, sets_asleep boolean, "
          "sets_hz double, was_asleep boolean, was_hz double, asleep boolean, hz double")
STATE = "serial_number string, asleep boolean, sample_frequency double, epoch bigint"


class SortedRuns:
    """Rows of one sensor and micro-batch in the order of a column, whatever their number.

    Up to `memory` rows are sorted as they are. Beyond that each `memory` rows become a sorted run, stored in pages in a map
    state (run, page); `fan` runs of one level are merged to one of the next. So memory holds `memory` rows, or a page of each
    of at most `fan` runs a level. Equal values keep the order in which they came.
    """

    def __init__(self, store, by: str, memory: int, page: int, fan: int) -> None:
        self._store, self._by, self._memory, self._page, self._fan = store, by, memory, page, fan
        self._held: list[pd.DataFrame] = []
        self._levels: list[list[tuple[int, int]]] = []  # (run, pages) of each level
        self._next = 0

    def add(self, rows: pd.DataFrame) -> None:
        for start in range(0, len(rows), self._memory):
            piece = rows.iloc[start:start + self._memory]
            if self._held and sum(map(len, self._held)) + len(piece) > self._memory:
                self._add_run(0, [self._sorted()])
            self._held.append(piece)

    def pages(self) -> Iterator[pd.DataFrame]:
        """All rows in order; the stored ones are removed as they are read."""
        runs = [run for level in reversed(self._levels) for run in level]
        held = [self._sorted()] if self._held else []
        self._levels = []
        if runs:
            yield from self._merged(runs, held)
        else:
            yield from held

    def _sorted(self) -> pd.DataFrame:
        held, self._held = self._held, []
        rows = held[0] if len(held) == 1 else pd.concat(held)
        return rows if rows[self._by].is_monotonic_increasing else rows.sort_values(self._by, kind="stable")

    def _add_run(self, level: int, pieces: Iterator[pd.DataFrame] | list[pd.DataFrame]) -> None:
        run, pages = self._next, 0
        self._next += 1
        for piece in pieces:
            for start in range(0, len(piece), self._page):
                self._store.updateValue((run, pages), (pickle.dumps(piece.iloc[start:start + self._page]),))
                pages += 1
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append((run, pages))
        if len(self._levels[level]) == self._fan:
            runs, self._levels[level] = self._levels[level], []
            self._add_run(level + 1, self._merged(runs))

    def _read(self, run: int, pages: int) -> Iterator[pd.DataFrame]:
        for page in range(pages):
            rows = pickle.loads(self._store.getValue((run, page))[0])
            self._store.removeKey((run, page))
            yield rows

    def _merged(self, runs: list[tuple[int, int]], held: Sequence[pd.DataFrame] = ()) -> Iterator[pd.DataFrame]:
        """Runs in the order they were made, so that equal values stay in order."""
        sources = [self._read(*run) for run in runs] + [iter([h]) for h in held]
        heads = [next(source, None) for source in sources]
        while any(head is not None for head in heads):
            # What is below the least last value of the pages at hand cannot be preceded by a page still to come. Of rows equal
            # to it, those up to the first source that ends there go too: a later page may begin with that value.
            border, first = min((head[self._by].iloc[-1], k) for k, head in enumerate(heads) if head is not None)
            out = []
            for k, head in enumerate(heads):
                if head is None:
                    continue
                cut = int(head[self._by].searchsorted(border, side="right" if k <= first else "left"))
                out.append(head.iloc[:cut])
                heads[k] = head.iloc[cut:] if cut < len(head) else next(sources[k], None)
            yield pd.concat(out).sort_values(self._by, kind="stable")


class SensorFold(StatefulProcessor):
    """Keeps (asleep, hz) per sensor and emits the state before and after every command.

    Only the state transition runs here; decoding before it and report texts after it are column
    expressions. One call sees one sensor's commands of one micro-batch, page by page in the order of arrival.
    """

    def __init__(self, memory: int = 50_000, page: int = 1_000, fan: int = 16) -> None:
        self._limits = (memory, page, fan)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("sensor", "asleep boolean, hz double")
        self._waiting = handle.getMapState("waiting", "run int, page int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        runs = SortedRuns(self._waiting, "arrival", *self._limits)
        for pdf in rows:
            runs.add(pdf)
        known = self._state.get()  # None at a sensor's first commands
        asleep, hz = known if known is not None else (None, None)
        for pdf in runs.pages():
            if asleep is None:
                asleep, hz = bool(pdf["start_asleep"].iloc[0]), pdf["start_hz"].iloc[0]
            hz = None if pd.isna(hz) else float(hz)
            out = {c: [] for c in ("was_asleep", "was_hz", "asleep", "hz")}
            # The state after a command is the last value set so far. Most sensors have few commands, for which a loop costs less
            # than columns do.
            for sets_asleep, sets_hz in zip(pdf["sets_asleep"].tolist(), pdf["sets_hz"].tolist()):
                out["was_asleep"].append(asleep)
                out["was_hz"].append(hz)
                if not pd.isna(sets_asleep):
                    asleep = bool(sets_asleep)
                if not pd.isna(sets_hz):
                    hz = float(sets_hz)
                out["asleep"].append(asleep)
                out["hz"].append(hz)
            columns = {c: pdf[c].array for c in ("serial_number", "time", "arrival", "command", "sets_asleep", "sets_hz")}
            yield pd.DataFrame(columns | {c: np.array(v, dtype=bool if "asleep" in c else float) for c, v in out.items()})
        if asleep is not None:
            self._state.update((asleep, None if pd.isna(hz) else float(hz)))

    def close(self) -> None:
        pass


def states(commands: DataFrame, initial: DataFrame, fold: SensorFold | None = None) -> DataFrame:
    """Stream of states: one row per command, see `OUTPUT`. `commands` as from `decode.commands`.

    `initial` is a static frame (serial_number, asleep, sample_frequency). The result has the columns
    `ops.reports` needs, which can be applied to the stream as it is.
    """
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    start = initial.select("serial_number", F.col("asleep").alias("start_asleep"),
                           F.col("sample_frequency").alias("start_hz"))
    rows = ops.effects(commands).select("serial_number", "time", "arrival", "command", "sets_asleep", "sets_hz") \
        .join(start, "serial_number", "left") \
        .withColumn("start_asleep", F.coalesce("start_asleep", F.lit(False)))
    return rows.groupBy("serial_number").transformWithStateInPandas(
        fold or SensorFold(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def _start(stream: DataFrame, handle, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def start(commands: DataFrame, initial: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
          ) -> StreamingQuery:
    """Write the state after every command below `folder`/states and the reports below `folder`/reports,
    one folder per micro-batch, which a repeated micro-batch replaces."""
    def handle(micro: DataFrame, epoch: int) -> None:
        micro = micro.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            micro.write.mode("overwrite").parquet(f"{folder}/states/epoch={epoch}")
            ops.reports(micro).write.mode("overwrite").parquet(f"{folder}/reports/epoch={epoch}")
        finally:
            micro.unpersist()

    return _start(states(commands, initial), handle, checkpoint, "update", trigger)


def start_folded(commands: DataFrame, initial: DataFrame, state: str, folder: str, checkpoint: str,
                 block: int = ops.BLOCK, trigger: dict | None = None) -> StreamingQuery:
    """Write the reports below `folder`/reports and the state after each micro-batch to the table `state`.

    The table (columns `STATE`, partitioned by ``epoch``) holds all commanded sensors as of a micro-batch;
    the partition before is the next one's input, older ones are dropped.
    """
    def handle(micro: DataFrame, epoch: int) -> None:
        spark = configure(micro.sparkSession)
        micro = micro.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            before = tables.fresh(spark, state).where(F.col("epoch") == epoch - 1).drop("epoch")
            known = before.unionByName(ingest.only_new(
                initial.select("serial_number", "asleep", "sample_frequency"), before, ["serial_number"]))
            after, reports = ops.fold(micro, known, block=block)
            reports.write.mode("overwrite").parquet(f"{folder}/reports/epoch={epoch}")
            after = after.unionByName(ingest.only_new(before, after, ["serial_number"]))
            after.withColumn("epoch", F.lit(epoch).cast("bigint")).write.insertInto(state, overwrite=True)
            tables.drop_before(spark, state, "epoch", epoch - 1)
        finally:
            micro.unpersist()

    return _start(commands, handle, checkpoint, "append", trigger)
