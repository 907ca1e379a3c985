"""Range expressions against brute force, and the edges of the quantile."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewire.operators import metrics

EPOCH = datetime(2024, 1, 1)
UTC0 = datetime(1970, 1, 1)


def us(t):
    return int((t - UTC0) / timedelta(microseconds=1))


@pytest.fixture(scope="module")
def raw():
    rnd = random.Random(3)
    out = {}
    for s in range(5):
        t, v, series = EPOCH + timedelta(seconds=s), 0.0, []
        for _ in range(rnd.randrange(2, 90)):
            t += timedelta(seconds=rnd.choice([10, 10, 10, 10, 7, 23, 400]))
            v = float(rnd.randrange(3)) if rnd.random() < 0.1 else v + rnd.randrange(5)
            series.append((t, v))
        out[f"s{s}"] = series
    # On the borders of steps, ranges and blocks.
    out["edge"] = [(EPOCH + timedelta(seconds=30 * i), float(i)) for i in range(50)]
    out["single"] = [(EPOCH + timedelta(seconds=15), 4.0)]
    return out


@pytest.fixture(scope="module")
def samples(spark, raw):
    data = [(s, t.replace(tzinfo=timezone.utc), v) for s, series in raw.items() for t, v in series]
    return spark.createDataFrame(data, "s string, ts timestamp, value double").persist()


def windows(series, range_s, step_s):
    """step -> samples in (step - range, step]."""
    first, last = us(series[0][0]), us(series[-1][0])
    step, reach = int(step_s * 1e6), int(range_s * 1e6)
    t = -(-first // step) * step
    while t < last + reach:
        inside = [(us(a), v) for a, v in series if t - reach < us(a) <= t]
        yield t, inside
        t += step


def brute_rate(raw, range_s, step_s, extrapolate):
    out = {}
    for s, series in raw.items():
        for t, w in windows(series, range_s, step_s):
            if len(w) < 2:
                continue
            gained = sum(b if b < a else b - a for (_, a), (_, b) in zip(w, w[1:]))
            if extrapolate:
                sampled = (w[-1][0] - w[0][0]) / 1e6
                gap = sampled / (len(w) - 1)
                a, b = (w[0][0] - (t - range_s * 1e6)) / 1e6, (t - w[-1][0]) / 1e6
                a = gap / 2 if a >= 1.1 * gap else a
                b = gap / 2 if b >= 1.1 * gap else b
                if gained > 0:
                    a = min(a, sampled * w[0][1] / gained)
                gained *= (sampled + a + b) / sampled
            out[s, t] = gained / range_s
    return out


def as_dict(df):
    rows = df.select("s", F.unix_micros("step").alias("us"), "rate").collect()
    out = {(r.s, r.us): r.rate for r in rows}
    assert len(out) == len(rows)
    return out


def assert_same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12), k


@pytest.mark.parametrize("range_s,step_s", [(60, 15), (60, 60), (10, 15), (300, 20), (45, 30)])
@pytest.mark.parametrize("block", ["1 minute", "5 minutes", "1 day"])
@pytest.mark.parametrize("extrapolate", [False, True])
def test_rate(samples, raw, range_s, step_s, block, extrapolate):
    got = metrics.rate(samples, ["s"], f"{range_s} seconds", f"{step_s} seconds", extrapolate, block)
    assert_same(as_dict(got), brute_rate(raw, range_s, step_s, extrapolate))


@pytest.mark.parametrize("block", ["1 minute", "1 day"])
def test_irate(samples, raw, block):
    want = {}
    for s, series in raw.items():
        for t, w in windows(series, 60, 15):
            if len(w) >= 2:
                (t0, a), (t1, b) = w[-2:]
                want[s, t] = (b if b < a else b - a) / ((t1 - t0) / 1e6)
    assert_same(as_dict(metrics.irate(samples, ["s"], "60 seconds", "15 seconds", block)), want)


def test_bounds():
    assert metrics.exponential_bounds(1, 2, 4) == [1, 2, 4, 8]
    assert len(metrics.exponential_bounds(*metrics.BATCH_SIZE_BUCKETS)) == 20
    assert metrics.exponential_bounds(*metrics.PROCESSING_SECONDS_BUCKETS)[-1] == pytest.approx(16.384)
    assert metrics.exponential_bounds(*metrics.END_TO_END_SECONDS_BUCKETS)[-1] == pytest.approx(20.48)


def test_histogram_counts_are_cumulative(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 9.0)], "v double")
    got = {r.le: r.bucket_count for r in metrics.histogram(df, "v", [1.0, 2.0]).collect()}
    assert got == {1.0: 2, 2.0: 3, math.inf: 4}


def quantile(spark, buckets, q):
    df = spark.createDataFrame([(1, le, float(c)) for le, c in buckets], "step int, le double, rate double")
    return metrics.histogram_quantile(df, [q]).first()[metrics.quantile_name(q)]


def test_quantile_edges(spark):
    inf = math.inf
    assert quantile(spark, [(1.0, 0), (2.0, 0), (inf, 0)], 0.5) is None
    assert quantile(spark, [(1.0, 0), (2.0, 0), (inf, 7)], 0.5) == 2.0
    assert quantile(spark, [(1.0, 4), (2.0, 4), (inf, 4)], 0.5) == 0.5
    assert quantile(spark, [(1.0, 2), (2.0, 6), (4.0, 10), (inf, 10)], 0.5) == 1.75
    assert quantile(spark, [(1.0, 5), (2.0, 5), (4.0, 10), (inf, 10)], 0.5) == 1.0
    assert quantile(spark, [(1.0, 5), (2.0, 10)], 0.5) is None
    assert quantile(spark, [(inf, 10)], 0.5) is None
    # A count that seems to fall is taken at its highest value so far.
    assert quantile(spark, [(1.0, 4), (2.0, 3), (4.0, 8), (inf, 8)], 0.75) == 3.0


def test_rate_spreads_a_series_over_blocks(samples):
    plan = metrics.rate(samples, ["s"], "60 seconds", "15 seconds")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines()
                 if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "__block" in exchanges[0]


def test_label_selector_on_a_map(spark):
    df = spark.createDataFrame([({"status": "success"}, 1.0), ({"status": "error"}, 2.0)],
                               "labels map<string,string>, value double")
    assert metrics.select_labels(df, status="success").count() == 1
    assert {r.status for r in metrics.label_columns(df, "status").collect()} == {"success", "error"}


def test_counter_samples_restart(spark):
    times = [EPOCH + timedelta(minutes=m) for m in (1, 2, 61, 200)]
    df = spark.createDataFrame([(t.replace(tzinfo=timezone.utc), "x") for t in times], "ts timestamp, s string")
    end = F.lit("2024-01-01 05:00:00").cast("timestamp")
    got = metrics.counter_samples(df, "ts", ["s"], "1 hour", end).orderBy("ts").collect()
    assert [r.value for r in got] == [2, 3, 3, 4, 4]
    restarted = metrics.counter_samples(df, "ts", ["s"], "1 hour", end, epoch="2 hours").orderBy("ts").collect()
    assert [r.value for r in restarted] == [2, 3, 1]


def test_samples_are_dealt_by_their_number(spark, monkeypatch):
    rows = [((EPOCH + timedelta(minutes=37 * k + s)).replace(tzinfo=timezone.utc), f"s{s}", float(k)) for s in range(60) for k in range(6)]
    df = spark.createDataFrame(rows, "ts timestamp, s string, v double")
    end = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def frames():
        counts = metrics.counter_samples(df, "ts", ["s"], "1 hour", end, epoch="8 hours")
        buckets = metrics.histogram_samples(df, "ts", "v", [1.0, 3.0], ["s"], "1 hour", end)
        return [counts, metrics.rate(counts, ["s"], "4 hours", "1 hour"), buckets,
                metrics.histogram_quantile(metrics.rate(buckets, ["s", "le"], "4 hours", "1 hour"), [0.5], ["s", "step"])]

    whole = [sorted(map(str, df.collect())) for df in frames()]
    monkeypatch.setattr(metrics, "TASK_SAMPLES", 100)
    for df_, expected in zip(frames(), whole):
        assert sorted(map(str, df_.collect())) == expected
        most = df_.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most <= 800  # of 1440 samples, or 4320 of buckets
    # A series of more samples than a task's is left to the blocks of time.
    monkeypatch.setattr(metrics, "TASK_SAMPLES", 10)
    assert [sorted(map(str, df_.collect())) for df_ in frames()] == whole


def test_backlog_counts_a_missing_side_as_zero(spark):
    p = spark.createDataFrame([(1, 5.0), (2, 3.0)], "step int, rate double")
    q = spark.createDataFrame([(2, 1.0), (3, 4.0)], "step int, rate double")
    got = {r.step: r.backlog for r in metrics.backlog(p, q).collect()}
    assert got == {1: 5.0, 2: 2.0, 3: -4.0}
