"""Counters, histograms and the range expressions computed over their samples.

A sample frame has a timestamp, label columns and a cumulative value. Rates are evaluated on a step
grid: a step t sees the samples in (t - range, t].
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import (
    bucket,
    bucket_ceil,
    explode_grid,
    from_micros,
    micros,
    shift,
    slot,
    slot_us,
    width_us,
)

# Bucket layout of the three ingest histograms as (start, factor, count).
BATCH_SIZE_BUCKETS = (1.0, 2.0, 20)
PROCESSING_SECONDS_BUCKETS = (0.001, 2.0, 15)
END_TO_END_SECONDS_BUCKETS = (0.01, 2.0, 12)

INF = float("inf")

#: A rank counts as reached within this relative error: bucket values are sums of quotients, whose last
#: digits depend on the order of summation.
RANK_TOLERANCE = 1e-9


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    return [start * factor**i for i in range(count)]


def select_labels(samples: DataFrame, **labels: str) -> DataFrame:
    """Label selector on plain label columns, or on a ``labels`` map where the column is absent."""
    for name, value in labels.items():
        col = F.col(name) if name in samples.columns else F.col("labels")[name]
        samples = samples.where(col == value)
    return samples


def label_columns(samples: DataFrame, *names: str) -> DataFrame:
    """Labels of the ``labels`` map as columns, the form the range expressions group by."""
    return samples.select(*[c for c in samples.columns if c != "labels"],
                          *[F.col("labels")[n].alias(n) for n in names])


# ---- building samples -----------------------------------------------------------------------------

def counter(df: DataFrame, labels: Sequence[str], value: Column | None = None) -> DataFrame:
    """Counter total per label set."""
    return df.groupBy(*labels).agg(F.sum(F.lit(1) if value is None else value).alias("value"))


#: Samples a task sorts and aggregates at once; samples compress so well that their shuffled bytes do not tell.
TASK_SAMPLES = 250_000


def deal(rows: DataFrame, source: DataFrame, ts: str, by: Sequence[str], each: int, step: str, end) -> DataFrame:
    """`rows` dealt by the labels `by` to so many tasks that each holds `TASK_SAMPLES` samples or so, however many there will be.

    They are bounded from `source`, read once: label sets times steps from the first time to `end` times `each`, the samples of a label
    set and step. What is computed per series afterwards stays in those tasks. Left as they are where a label set may have more
    than a task's samples, since then blocks of time are what can be spread, and where one task holds all.
    """
    steps = (micros(end) - micros(F.min(ts))) / F.lit(width_us(step)) + 1
    n, steps = source.agg(F.approx_count_distinct(F.xxhash64(*by)), steps).first()
    if not n or steps is None or steps <= 0 or steps * each > TASK_SAMPLES:
        return rows
    tasks = math.ceil(n * steps * each / TASK_SAMPLES)
    return rows.repartition(tasks, *by) if tasks > 1 else rows


def counter_samples(df: DataFrame, ts: str, labels: Sequence[str], step: str, end,
                    epoch: str | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Running counter per label set, sampled at every step from its first increment to `end`.

    `epoch` restarts the count at each bucket of that width, as a process restart would. Increments are
    summed per step first, so the windows below order one row per step whatever the number of events. `by` are the labels that
    tell most series apart; rows are dealt by them (all if not given).
    """
    step_col = bucket_ceil(ts, step)
    inc = df.groupBy(*labels, step_col.alias("ts")).agg(F.count("*").alias("inc"))
    inc = deal(inc, df, ts, by or labels, 1, step, end)
    restart = [bucket(shift("ts", -1), epoch).alias("__epoch")] if epoch else []
    inc = inc.select("*", *restart)
    series = [*labels, "__epoch"] if epoch else list(labels)
    order = W.partitionBy(*series).orderBy("ts")
    run = inc.select(
        "*",
        F.sum("inc").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("value"),
        F.lead("ts").over(order).alias("__next"),
    )
    stop = F.least(shift("__epoch", width_us(epoch)), end) if epoch else end
    until = F.coalesce(shift("__next", -1), stop)
    return explode_grid(run.withColumn("__until", until), F.col("ts"), F.col("__until"), step, "ts").select(
        *labels, "ts", F.col("value").cast("double").alias("value"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram: one row per (labels, le) with the count of values <= le, the last le being
    infinity, plus the sum and count of all values.

    Every bound is a conditional count in one hash aggregate, so rows are never multiplied.
    """
    v = F.col(value)
    counts = [F.count_if(v <= F.lit(b)).alias(f"__le{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*labels).agg(*counts, F.count(v).alias("count"), F.sum(v).alias("sum"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__le{i}").alias("bucket_count"))
             for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(INF).alias("le"), F.col("count").alias("bucket_count")))
    return wide.select(*labels, "count", "sum", F.inline(F.array(*pairs)))


def histogram_samples(df: DataFrame, ts: str, value: str, bounds: Sequence[float], labels: Sequence[str],
                      step: str, end) -> DataFrame:
    """Running bucket counts per label set at every step from the first observation to `end`."""
    per_step = histogram(df.withColumn("__at", bucket_ceil(ts, step)), value, bounds, [*labels, "__at"])
    if labels:
        per_step = deal(per_step, df, ts, labels, len(bounds) + 1, step, end)
    order = W.partitionBy(*labels, "le").orderBy("__at")
    run = per_step.select(
        *labels, "le", "__at",
        F.sum("bucket_count").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("value"),
        F.lead("__at").over(order).alias("__next"),
    )
    until = F.coalesce(shift("__next", -1), end)
    return explode_grid(run.withColumn("__until", until), F.col("__at"), F.col("__until"), step, "ts").select(
        *labels, "le", "ts", F.col("value").cast("double").alias("value"))


# ---- range expressions ----------------------------------------------------------------------------

_BLOCK = "__block"


def _blocks(samples: DataFrame, series: Sequence[str], reach: int, width: int):
    """Samples in microseconds, each in its own block of the time line and in every block a step that
    still sees it may fall into: (rows, window per series and block).

    A series is thus cut into blocks that are worked on independently, with a single shuffle, however
    many samples it has. Steps are evaluated in the block they lie in.
    """
    us = micros("ts")
    # Blocks are (start, end], numbered by their end, which makes the sample at a border part of the
    # block before it, like the steps.
    blocks = F.sequence(slot(us, width), slot(us + F.lit(reach - 1), width))
    rows = samples.select(*series, us.alias("__us"), F.col("value").cast("double").alias("value"),
                          F.explode(blocks).alias(_BLOCK))
    return rows, W.partitionBy(*series, _BLOCK).orderBy("__us")


def _seen(at_or_after: Column, before: Column, step: int, width: int) -> tuple[Column, Column]:
    """First step number and count of steps in [at_or_after, before) inside the row's block."""
    end = slot_us(F.col(_BLOCK), width)
    first = slot(F.greatest(at_or_after, end - F.lit(width - 1)), step)
    count = slot(F.least(before, end + F.lit(1)), step) - first
    return first, F.greatest(count, F.lit(0))


def rate(samples: DataFrame, series: Sequence[str], range_: str, step: str, extrapolate: bool = False,
         block: str = "1 day") -> DataFrame:
    """Per-second increase of a cumulative counter over the range, per series and step.

    A decrease counts as a restart from zero. A step with fewer than two samples in range has no row.
    Plain mode divides the increase by the range; ``extrapolate`` stretches it towards the range borders
    the way PromQL's ``rate`` does.

    Every sample knows the steps at which it is the oldest one in range and those at which it is the
    newest. The two meet in one aggregate per step, which needs no further shuffle.
    """
    reach, step_us, width = width_us(range_), width_us(step), width_us(block)
    rows, order = _blocks(samples, series, reach, width)
    us, value, before = F.col("__us"), F.col("value"), F.lag("value").over(order)
    rows = rows.select(
        "*",
        F.lag("__us").over(order).alias("__prev"), F.lead("__us").over(order).alias("__next"),
        F.row_number().over(order).alias("__rank"),
        F.when(value < before, value).otherwise(value - before).alias("__delta"),
    )
    grown = F.coalesce(F.sum("__delta").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0.0))
    leaves = us + F.lit(reach)
    newest, n_newest = _seen(us, F.least(F.coalesce("__next", leaves), leaves), step_us, width)
    oldest, n_oldest = _seen(F.greatest(us, F.coalesce(F.col("__prev") + F.lit(reach), us)), leaves, step_us, width)
    rows = rows.select(
        *series, _BLOCK, "__us", "value", "__rank", grown.alias("__grown"), newest.alias("__newest"),
        n_newest.alias("__n"), oldest.alias("__oldest"), (n_newest + n_oldest).alias("__all"),
    ).where("__all > 0")
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__all"))))
    closes = F.col("__i") <= F.col("__n")
    number = F.when(closes, F.col("__newest") + F.col("__i")).otherwise(
        F.col("__oldest") + F.col("__i") - F.col("__n")) - F.lit(1)
    sign = F.when(closes, F.lit(1)).otherwise(F.lit(-1))
    aggs = [F.sum(F.col("__grown") * sign).alias("__gained"), F.sum(F.col("__rank") * sign).alias("__gaps")]
    if extrapolate:
        aggs += [F.max(F.when(closes, us)).alias("__last"), F.max(F.when(~closes, us)).alias("__first"),
                 F.max(F.when(~closes, value)).alias("__first_value")]
    per_step = rows.withColumn("__step", number).groupBy(*series, _BLOCK, "__step").agg(*aggs).where("__gaps > 0")
    at, gained = slot_us(F.col("__step"), step_us), F.col("__gained")
    if extrapolate:
        sampled = (F.col("__last") - F.col("__first")) / F.lit(1e6)
        gap = sampled / F.col("__gaps")
        to_start = (F.col("__first") - (at - F.lit(reach))) / F.lit(1e6)
        to_end = (at - F.col("__last")) / F.lit(1e6)
        to_start = F.when(to_start >= gap * F.lit(1.1), gap / 2).otherwise(to_start)
        to_end = F.when(to_end >= gap * F.lit(1.1), gap / 2).otherwise(to_end)
        # A counter cannot have been below zero: do not stretch past the point where it was zero.
        to_zero = sampled * F.col("__first_value") / F.col("__gained")
        to_start = F.when((gained > 0) & (to_zero < to_start), to_zero).otherwise(to_start)
        gained = gained * (sampled + to_start + to_end) / sampled
    return per_step.select(*series, from_micros(at, samples.schema["ts"].dataType).alias("step"),
                           (gained / F.lit(reach / 1e6)).alias("rate"))


def irate(samples: DataFrame, series: Sequence[str], range_: str, step: str, block: str = "1 day") -> DataFrame:
    """Per-second change between the last two samples in range, per series and step."""
    reach, step_us, width = width_us(range_), width_us(step), width_us(block)
    rows, order = _blocks(samples, series, reach, width)
    us, value = F.col("__us"), F.col("value")
    rows = rows.select(
        "*",
        F.lag("__us").over(order).alias("__prev"), F.lead("__us").over(order).alias("__next"),
        F.lag("value").over(order).alias("__before"),
    ).where(F.col("__prev").isNotNull())
    leaves = F.col("__prev") + F.lit(reach)
    first, count = _seen(us, F.least(F.coalesce("__next", leaves), leaves), step_us, width)
    gained = F.when(value < F.col("__before"), value).otherwise(value - F.col("__before"))
    rows = rows.select(*series, first.alias("__step"), count.alias("__n"),
                       (gained * F.lit(1e6) / (us - F.col("__prev"))).alias("rate")).where("__n > 0")
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    at = slot_us(F.col("__step") + F.col("__i"), step_us)
    return rows.select(*series, from_micros(at, samples.schema["ts"].dataType).alias("step"), "rate")


def sum_by(df: DataFrame, value: str, labels: Sequence[str] = (), step: str = "step") -> DataFrame:
    """Sum across series per step, keeping the given labels."""
    return df.groupBy(step, *labels).agg(F.sum(value).alias(value))


def latest_samples(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """Newest sample per series."""
    return samples.groupBy(*series).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def histogram_quantile(buckets: DataFrame, qs: Sequence[float], by: Sequence[str] = ("step",),
                       value: str = "rate") -> DataFrame:
    """Quantiles from cumulative bucket values, one column q<percent> per quantile.

    Linear inside the first bucket that reaches the rank, the first bucket starting at 0; the highest
    finite bound when only the infinite bucket reaches it; NULL for an empty histogram and for one
    without an infinite bucket. A group holds one row per bound.
    """
    order = W.partitionBy(*by).orderBy("le")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # A cumulative count cannot fall from one bound to the next; restarts may make it look so.
    upto, before = (order.rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    rows = buckets.select(
        *by, "le",
        F.max(value).over(upto).alias("__c"),
        F.lag("le", 1, 0.0).over(order).alias("__from"),
        F.coalesce(F.max(value).over(before), F.lit(0.0)).alias("__below"),
        F.max(value).over(whole).alias("__total"),
        ((F.last("le").over(whole) == F.lit(INF)) & (F.count("*").over(whole) > 1)).alias("__complete"),
    )
    le, c, start, below = (F.col(x) for x in ("le", "__c", "__from", "__below"))
    aggs = []
    for q in qs:
        rank = F.col("__total") * F.lit(q)
        inside = start + (le - start) * (rank - below) / (c - below)
        at = F.when(le == F.lit(INF), start).when((start == 0.0) & (le <= 0.0), le).otherwise(inside)
        hit = F.col("__complete") & (F.col("__total") > 0) & (c >= rank * F.lit(1 - RANK_TOLERANCE))
        aggs.append(F.min_by(F.when(hit, at), F.when(hit, le)).alias(quantile_name(q)))
    return rows.groupBy(*by).agg(*aggs)


def quantile_name(q: float) -> str:
    return f"q{round(q * 100)}"


def success_rate(samples: DataFrame, series: Sequence[str], range_: str, step: str,
                 block: str = "1 day", extrapolate: bool = False) -> DataFrame:
    """100 · rate(success) / rate(all) per step, from one pass over the samples; ``extrapolate`` as in `rate`."""
    r = rate(samples, [*series, "status"], range_, step, extrapolate, block)
    ok = F.sum(F.when(F.col("status") == "success", F.col("rate")))
    return r.groupBy("step").agg(
        (F.lit(100.0) * F.try_divide(ok, F.sum("rate"))).alias("success_pct")
    )


def backlog(published: DataFrame, processed: DataFrame) -> DataFrame:
    """Publish rate, processing rate and their difference per step; a missing side counts as 0."""
    p = published.select("step", F.col("rate").alias("published"))
    q = processed.select("step", F.col("rate").alias("processed"))
    diff = F.coalesce("published", F.lit(0.0)) - F.coalesce("processed", F.lit(0.0))
    return p.join(q, "step", "full").select("step", "published", "processed", diff.alias("backlog"))


def overlay(**series: DataFrame) -> DataFrame:
    """Several (step, rate) frames as one long frame with a ``series`` label."""
    out = None
    for name, df in series.items():
        labelled = df.select(F.lit(name).alias("series"), "step", "rate")
        out = labelled if out is None else out.unionByName(labelled)
    return out
