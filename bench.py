"""Times the headline queries; prints one JSON line.

Every query is run over whole tables and its full result is produced (noop sink). The warm-up runs the
same queries on the smallest scale, so that compilation of the plans is not what is measured; then the
better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.plans import bindings  # noqa: E402
from tidewire.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "series_gapfill", "series_raw", "panel_reducers", "sensor_lag", "insert_rate",
    "decode_measurements", "ingest_strict", "ingest_dedup", "batch_stats", "pack_payload",
    "counter_rate", "counter_rate_total", "instant_rate", "histogram_build", "histogram_quantile", "success_rate",
    "statement_base", "snapshot_totals", "snapshot_delta", "slowest_queries",
    "chunk_catalog", "compaction", "command_state", "command_logs", "blocking_pairs",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        # Shuffles of a megabyte feed stages that multiply rows: keep all cores on them.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        for name in names:
            run(spark, name, warm)
    seconds = {name: round(min(run(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
           "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}
    if "ingest_dedup" in seconds:
        # Every event arrives twice.
        rows = 2 * bindings.load(spark, sf_dir, "events").count()
        out["ingest_rows_per_sec"] = round(rows / seconds["ingest_dedup"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
