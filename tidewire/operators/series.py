"""Reading the measurement table back: joined series, gap-filled buckets, lag, rates and reducers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import bucket, explode_grid, instant, seconds_between, shift, window_start

Serials = Sequence[str] | DataFrame | None


def in_range(df: DataFrame, start: str | datetime | None, end: str | datetime | None,
             ts: str = "time", chunk: str | None = None) -> DataFrame:
    """start <= ts < end. On a chunked table the chunk column is bounded too, which prunes partitions.

    A chunk starts no later than its rows, so the upper bound holds for any chunk width. The lower bound needs the
    width the table was written with (`chunk`, see `sources.tables.chunk_width`); without it none is set.
    """
    if start is not None:
        df = df.where(F.col(ts) >= instant(start))
    if end is not None:
        df = df.where(F.col(ts) < instant(end))
    if "chunk_start" in df.columns:
        if start is not None and chunk is not None:
            df = df.where(F.col("chunk_start") >= bucket(instant(start), chunk))
        if end is not None:
            df = df.where(F.col("chunk_start") < instant(end))
    return df


def pick_sensors(sensor: DataFrame, serials: Serials) -> DataFrame:
    """Registry rows (id, serial_number) of the chosen serials.

    `serials` is a list, or a frame with a ``serial_number`` column when the choice is itself a query.
    """
    picked = sensor.select("id", "serial_number")
    if serials is None:
        return picked
    if isinstance(serials, DataFrame):
        return picked.join(serials.select("serial_number"), "serial_number", "left_semi").select(
            "id", "serial_number")
    return picked.where(F.col("serial_number").isin(list(serials)))


def read_series(m: DataFrame, sensor: DataFrame, serials: Serials = None, start=None, end=None,
                ordered: bool = True, chunk: str | None = None) -> DataFrame:
    """(time, measurement, serial_number) of the chosen sensors in [start, end), in time order.

    Catalyst broadcasts the registry side while its size allows it and otherwise merges sorted sides,
    where adaptive execution splits a sensor that dominates.
    """
    out = (
        in_range(m, start, end, chunk=chunk)
        .join(pick_sensors(sensor, serials), F.col("sensor_id") == F.col("id"))
        .select("time", "measurement", "serial_number")
    )
    return out.orderBy("time", "serial_number") if ordered else out


def bucket_avg(m: DataFrame, width: str, keys: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """Mean and row count per (bucket, key)."""
    return m.groupBy(window_start("time", width).alias("bucket"), *keys).agg(
        F.avg("measurement").alias("measurement"), F.count("*").alias("n")
    )


def gapfill_avg(m: DataFrame, sensor: DataFrame, width: str, start, end, serials: Serials = None,
                ordered: bool = True, chunk: str | None = None) -> DataFrame:
    """Mean per (bucket, serial), with a row for every bucket of [start, end) for every serial that has
    at least one row there; NULL where a bucket is empty.

    Rows are averaged per (bucket, sensor_id) before anything is shuffled or joined; a serial is unique,
    so grouping by its id is the same grouping. Each filled bucket then emits itself and the empty
    buckets up to the next filled one, so no spine has to be built and joined. The window orders at
    most one row per bucket of the range, however many measurements a sensor has.
    """
    rows = in_range(m, start, end, chunk=chunk)
    if serials is not None:
        rows = rows.join(pick_sensors(sensor, serials).select("id"),
                         F.col("sensor_id") == F.col("id"), "left_semi")
    means = bucket_avg(rows, width).drop("n")
    order = W.partitionBy("sensor_id").orderBy("bucket")
    first, last = bucket(instant(start), width), shift(instant(end), -1)
    kind = m.schema["time"].dataType
    filled = means.select(
        "*",
        F.when(F.lag("bucket").over(order).isNull(), first.cast(kind)).otherwise(F.col("bucket")).alias("__from"),
        F.coalesce(shift(F.lead("bucket").over(order), -1), last.cast(kind)).alias("__until"),
    ).join(sensor.select("id", "serial_number"), F.col("sensor_id") == F.col("id"))
    out = explode_grid(filled, F.col("__from"), F.col("__until"), width, "time").select(
        "time", F.when(F.col("time") == F.col("bucket"), F.col("measurement")).alias("measurement"),
        "serial_number")
    return out.orderBy("time", "serial_number") if ordered else out


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest (ts, tie) per key, as an aggregate with map-side combine.

    (ts, tie) is unique per key, so every column comes from the same row.
    """
    order = F.struct(ts, *tie) if tie else F.col(ts)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)


#: Values that one task sorts, and value ranges a pass counts.
SELECTED, SPLITS = 10_000, 64


def percentiles(df: DataFrame, value: str, qs: Sequence[float], selected: int = SELECTED, splits: int = SPLITS) -> list[float | None]:
    """Exact percentiles of all values, interpolated, however many there are: no task ever holds them.

    A percentile lies between two ranks. A rank is looked for in passes: values near the quantiles of what is left (from a bounded
    sketch) cut it into ranges, the values in each are counted, and only the range that holds the rank is left, until it is the
    cut itself or small enough to be sorted. Nulls do not count; NaN is larger than any number.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where(v.isNotNull())
    n = rows.count()
    if not n:
        return [None for _ in qs]

    def at(rank: int) -> float:
        low, high, below = None, None, 0  # low < the value < high; `below` values are not above low
        while True:
            left = rows
            if low is not None:
                left = left.where(F.col("v") > F.lit(low))
            if high is not None:
                left = left.where(F.col("v") < F.lit(high))
            cuts = left.agg(F.percentile_approx("v", [i / splits for i in range(splits + 1)], 10_000).alias("c"), F.count("*").alias("n")).first()
            if cuts["n"] <= selected:
                return left.orderBy("v").limit(rank - below + 1).agg(F.max("v")).first()[0]
            cuts = sorted(set(cuts["c"]), key=lambda c: (c != c, c))
            counts = left.agg(*[F.count_if(F.col("v") < F.lit(c)).alias(f"b{i}") for i, c in enumerate(cuts)],
                              *[F.count_if(F.col("v") == F.lit(c)).alias(f"e{i}") for i, c in enumerate(cuts)]).first()
            for i, c in enumerate(cuts):
                less, upto = below + counts[f"b{i}"], below + counts[f"b{i}"] + counts[f"e{i}"]
                if less <= rank < upto:
                    return c
                if rank < less:
                    high = c
                    break
                low, after = c, upto
            below = after if low is not None else below

    out = []
    for q in qs:
        place = q * (n - 1)
        rank = int(place)
        first = at(rank)
        out.append(first if place == rank else first + (at(rank + 1) - first) * (place - rank))
    return out


def reduce(df: DataFrame, value: str, ts: str, by: Sequence[str] = (),
           calcs: Sequence[str] = ("lastNotNull", "last", "mean", "max", "sum", "p99")) -> DataFrame:
    """Panel reducers over series that are already on a step grid, so a group holds one row per step.

    Without `by` everything is one group: its percentile is then selected in passes, at once.
    """
    if not by and "p99" in calcs:
        p99 = F.lit(percentiles(df, value, [0.99])[0]).cast("double").alias("p99")
        others = [c for c in calcs if c != "p99"]
        rest = reduce(df, value, ts, (), others) if others else df.sparkSession.range(1)
        return rest.select(*[p99 if c == "p99" else F.col(c) for c in calcs])
    v, t = F.col(value), F.col(ts)
    exprs: dict[str, Column] = {
        "lastNotNull": F.max_by(v, F.when(v.isNotNull(), t)),
        "last": F.max_by(v, t),
        "mean": F.avg(v),
        "max": F.max(v),
        "sum": F.sum(v),
        "p99": F.percentile(v, F.lit(0.99)),
    }
    return df.groupBy(*by).agg(*[exprs[c].alias(c) for c in calcs])


def sensor_counts(m: DataFrame, sensor: DataFrame, retention_seconds: int = 1800) -> DataFrame:
    """Rows per sensor next to the steady state its sample frequency implies; silent sensors show 0."""
    n = m.groupBy("sensor_id").agg(F.count("*").alias("n"))
    return sensor.join(n, F.col("id") == F.col("sensor_id"), "left").select(
        "serial_number",
        F.coalesce("n", F.lit(0)).alias("row_count"),
        (F.col("sample_frequency") * F.lit(float(retention_seconds))).alias("expected_rows"),
    )


def insert_rate(m: DataFrame, sensor: DataFrame, start, end, chunk: str | None = None) -> DataFrame:
    """Rows per second and sensor over [start, end) next to the configured frequency."""
    n = in_range(m, start, end, chunk=chunk).groupBy("sensor_id").agg(F.count("*").alias("n"))
    span = seconds_between(instant(start), instant(end))
    return sensor.join(n, F.col("id") == F.col("sensor_id"), "left").select(
        "serial_number",
        (F.coalesce("n", F.lit(0)) / span).alias("rows_per_second"),
        F.col("sample_frequency").alias("expected_per_second"),
    )


def sensor_lag(m: DataFrame, sensor: DataFrame, as_of) -> DataFrame:
    """Seconds since a sensor's last measurement; NULL for a sensor that never reported."""
    last = m.groupBy("sensor_id").agg(F.max("time").alias("last_time"))
    return sensor.join(last, F.col("id") == F.col("sensor_id"), "left").select(
        "serial_number", "last_time", seconds_between("last_time", instant(as_of)).alias("lag_seconds")
    )
