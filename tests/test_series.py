from conftest import rows
from pyspark.sql import functions as F

from tidewire.operators import lifecycle, series
from tidewire.sources import tables


def measurements(spark, data):
    return spark.createDataFrame(data, "sensor_id int, t string, measurement double").select(
        F.col("t").cast("timestamp").alias("time"), "sensor_id", "measurement")


def registry(spark):
    return spark.createDataFrame([(1, "A", 2.0), (2, "B", 1.0), (3, "C", None)],
                                 "id int, serial_number string, sample_frequency double")


def short(df):
    return [(str(r.time)[11:16], r.measurement, r.serial_number) for r in df.withColumn(
        "time", F.col("time").cast("string")).collect()]


DATA = [(1, "2024-01-01 00:12:00", 1.0), (1, "2024-01-01 00:14:00", 3.0), (1, "2024-01-01 00:41:00", 5.0),
        (2, "2024-01-01 00:20:00", 7.0), (2, "2024-01-01 02:00:00", 9.0), (3, "2024-01-01 03:00:00", 1.0)]


def test_gapfill_bounds(spark):
    """Buckets start at the floor of the start, the end is open, and silent sensors get no spine."""
    got = series.gapfill_avg(measurements(spark, DATA), registry(spark), "10 minutes", "2024-01-01 00:05:00",
                             "2024-01-01 00:50:00")
    assert short(got) == [
        ("00:00", None, "A"), ("00:00", None, "B"), ("00:10", 2.0, "A"), ("00:10", None, "B"),
        ("00:20", None, "A"), ("00:20", 7.0, "B"), ("00:30", None, "A"), ("00:30", None, "B"),
        ("00:40", 5.0, "A"), ("00:40", None, "B")]


def test_gapfill_of_chosen_serials(spark):
    got = series.gapfill_avg(measurements(spark, DATA), registry(spark), "30 minutes", "2024-01-01 00:00:00",
                             "2024-01-01 01:00:00", serials=["B", "nobody"])
    assert short(got) == [("00:00", 7.0, "B"), ("00:30", None, "B")]


def test_read_series(spark):
    m, s = measurements(spark, DATA), registry(spark)
    got = series.read_series(m, s, ["A", "C"], "2024-01-01 00:14:00", "2024-01-01 03:00:00")
    assert short(got) == [("00:14", 3.0, "A"), ("00:41", 5.0, "A")]
    chosen = s.where("sample_frequency > 1").select("serial_number")
    assert short(series.read_series(m, s, chosen)) == short(series.read_series(m, s, ["A"]))
    assert len(short(series.read_series(m, s))) == 6


def test_time_range_prunes_chunks(spark, name):
    tables.create_measurements(spark, name)
    tables.write_measurements(measurements(spark, DATA).withColumn("arrival", F.lit(1)), name, ["arrival"])
    m = tables.fresh(spark, name)
    q = series.read_series(m, registry(spark), ["A"], "2024-01-01 00:12:00", "2024-01-01 00:30:00", ordered=False)
    assert short(q.orderBy("time")) == [("00:12", 1.0, "A"), ("00:14", 3.0, "A")]
    plan = q._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "chunk_start" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert filters.count("chunk_start") >= 2


def test_point_lookup_prunes_hash_partitions(spark, name):
    tables.create_measurements(spark, name)
    tables.write_measurements(measurements(spark, DATA).withColumn("arrival", F.lit(1)), name, ["arrival"])
    q = lifecycle.of_sensors(tables.fresh(spark, name), [2])
    assert sorted(r.measurement for r in q.collect()) == [7.0, 9.0]
    assert "hash_part" in q._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_lag_shows_silent_sensors(spark):
    s = registry(spark).unionByName(spark.createDataFrame([(4, "D", 1.0)], registry(spark).schema))
    got = {r.serial_number: r.lag_seconds for r in
           series.sensor_lag(measurements(spark, DATA), s, "2024-01-01 03:00:30").collect()}
    assert got == {"A": 8370.0, "B": 3630.0, "C": 30.0, "D": None}


def test_counts_and_rates(spark):
    m, s = measurements(spark, DATA), registry(spark)
    assert rows(series.sensor_counts(m, s)) == [("A", 3, 3600.0), ("B", 2, 1800.0), ("C", 1, None)]
    got = series.insert_rate(m, s, "2024-01-01 00:00:00", "2024-01-01 00:01:40")
    assert rows(got) == [("A", 0.0, 2.0), ("B", 0.0, 1.0), ("C", 0.0, None)]


def test_latest(spark):
    got = series.latest_by(measurements(spark, DATA), ["sensor_id"], "time")
    assert sorted((r.sensor_id, r.measurement) for r in got.collect()) == [(1, 5.0), (2, 9.0), (3, 1.0)]


def test_reducers(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, None)], "t int, v double")
    r = series.reduce(df, "v", "t").first().asDict()
    assert r == {"lastNotNull": 8.0, "last": None, "mean": 6.0, "max": 8.0, "sum": 12.0, "p99": 7.96}


def test_chunk_catalog_and_skipping(spark):
    m = lifecycle.with_chunk(measurements(spark, DATA))
    catalog = lifecycle.chunk_catalog(m, "2024-01-01 00:35:00")
    by_start = {str(r.chunk_start)[11:16]: r for r in catalog.withColumn(
        "chunk_start", F.col("chunk_start").cast("string")).collect()}
    assert by_start["00:10"].row_count == 2 and by_start["00:10"].age_minutes == 20.0 and by_start["00:10"].compacted
    assert not by_start["00:20"].compacted
    kept = lifecycle.prune(m, catalog, 2, 3, "2024-01-01 00:00:00", "2024-01-01 02:30:00")
    assert sorted(r.measurement for r in kept.collect()) == [7.0, 9.0]
    flags = lifecycle.skipping(catalog, 2, 3, "2024-01-01 00:00:00", "2024-01-01 02:30:00")
    assert flags.where("not skipped").count() == 2


def test_percentiles_of_everything(spark):
    import numpy as np

    r = np.random.default_rng(3)
    for x in (r.normal(size=3001), np.concatenate([np.full(2000, 7.0), r.normal(size=999)]), 10.0 ** r.uniform(-300, 300, 2500), np.array([5.0]),
              r.integers(0, 5, 3000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
        qs = [0, 0.01, 0.25, 0.5, 0.99, 1]
        got = series.percentiles(df, "v", qs, selected=50, splits=8)
        assert np.allclose(got, np.quantile(x, qs), rtol=1e-12, atol=0)
    empty = spark.createDataFrame([(None,)], "v double")
    assert series.percentiles(empty, "v", [0.5]) == [None]
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert series.percentiles(nan, "v", [0.5])[0] == 2.0
