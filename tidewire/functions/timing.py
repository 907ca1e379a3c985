"""Time arithmetic as column expressions. All of them keep the type of the timestamp they are given."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_UNIT_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}

#: Buckets are aligned to this Monday, so that weekly buckets start on Mondays.
_ORIGIN_US = int((datetime(2000, 1, 3) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def width_us(width: str | timedelta) -> int:
    """'5 minutes' or a timedelta as microseconds."""
    if isinstance(width, timedelta):
        return int(width / timedelta(microseconds=1))
    amount, unit = width.split()
    return int(float(amount) * _UNIT_US[unit.rstrip("s")])


def instant(value: str | datetime) -> Column:
    """A literal point in time without zone; comparisons with either timestamp type still push down."""
    return F.lit(str(value)).cast("timestamp_ntz")


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def micros(col: str | Column) -> Column:
    return F.unix_micros(_col(col).cast("timestamp"))


def shift(col: str | Column, by_us: int | Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(by_us) if isinstance(by_us, int) else by_us, _col(col))


def bucket(col: str | Column, width: str | timedelta) -> Column:
    """Start of the fixed-width bucket that holds the timestamp."""
    w = width_us(width)
    return shift(col, -F.pmod(micros(col) - F.lit(_ORIGIN_US % w), F.lit(w)))


def window_start(col: str | Column, width: str | timedelta) -> Column:
    """`bucket` as a grouping expression: cheaper, but at most one per select, and NULL times are dropped."""
    w = width_us(width)
    return F.window(_col(col), f"{w} microseconds", startTime=f"{_ORIGIN_US % w} microseconds")["start"]


def bucket_ceil(col: str | Column, width: str | timedelta) -> Column:
    """First bucket boundary at or after the timestamp."""
    w = width_us(width)
    return shift(col, F.pmod(F.lit(_ORIGIN_US % w) - micros(col), F.lit(w)))


def from_micros(us: Column, like: DataType) -> Column:
    """Inverse of `micros` for a column of the given timestamp type."""
    return F.timestamp_micros(us).cast(like)


def explode_grid(df: DataFrame, first: Column, last: Column, width: str | timedelta, name: str) -> DataFrame:
    """One row per point first, first+width, … up to and including `last`; none when first > last."""
    w = width_us(width)
    steps = F.floor((micros(last) - micros(first)) / F.lit(w)).cast("int")
    # sequence() counts downwards when its bounds are reversed, so that case is cut explicitly.
    upto = F.when(steps >= 0, F.sequence(F.lit(0), F.greatest(steps, F.lit(0))))
    points = df.withColumn("__first", first).withColumn("__i", F.explode(upto))
    return points.withColumn(name, shift("__first", F.col("__i").cast("bigint") * F.lit(w))).drop("__first", "__i")


def slot(us: Column, width: int) -> Column:
    """Number of the first boundary of a grid of `width` microseconds at or after `us`."""
    return F.ceil((us - F.lit(_ORIGIN_US % width)) / F.lit(width))


def slot_us(number: Column, width: int) -> Column:
    """Position of a numbered boundary."""
    return number * F.lit(width) + F.lit(_ORIGIN_US % width)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def age_minutes(end: str | Column, as_of: Column) -> Column:
    return seconds_between(end, as_of) / F.lit(60.0)


def rfc3339(col: str | Column) -> Column:
    """UTC text with up to six fraction digits, trailing zeros and a bare point removed."""
    text = F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))
