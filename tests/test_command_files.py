"""The messages of the command streams as files: several of each cut of the arrivals, cut after cut."""

import os
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from conftest import rows

from tidewire.plans import streams

KINDS = ["click", "view", "purchase", "signup", "error"]


def test_cuts_of_many_commands_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1)
    events = [(i, start + timedelta(minutes=i), i % 7, KINDS[i % 5], float(i % 300), f'{{"k": {i % 100}}}') for i in range(600)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"sensor{k}", float(k), 0) for k in range(6)],
                          "c_custkey bigint, c_name string, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    expected = rows(streams.commands(spark, str(tmp_path)))
    assert len(expected) == 515
    monkeypatch.setattr(streams, "FILE_ROWS", 20, raising=False)
    streams._commands(spark, str(tmp_path), f"{tmp_path}/work")
    folder = f"{tmp_path}/work/messages"
    files = sorted((f.path for f in os.scandir(folder) if f.name.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    parts, rest = divmod(len(files), streams.FILES)
    assert parts > 1 and rest == 0
    found = [pq.read_table(f)["arrival"].to_pylist() for f in files]
    assert all(found) and sum(map(len, found)) == len(expected)
    for k, arrivals in enumerate(found):
        assert all(a * streams.FILES // 600 == k // parts for a in arrivals)
    assert rows(streams.commands(spark, str(tmp_path))) == expected
