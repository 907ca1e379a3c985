"""Tables written by micro-batch keep few partitions and lose no row."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewire.sources import epochs, tables


def batch(spark, epoch, n=2):
    return spark.range(n).select((F.col("id") + 10 * epoch).alias("v"))


def held(spark, name):
    return sorted((r.epoch, r.v) for r in epochs.read(spark, name).collect())


def want(upto, n=2):
    return [(e, 10 * e + i) for e in range(upto) for i in range(n)]


def test_partitions_stay_few_over_many_micro_batches(spark, name):
    most = 0
    for e in range(200):
        epochs.append(batch(spark, e, 1), name, e, width=6)
        if e % 6 == 5:  # just before a fold
            most = max(most, len(epochs.spans(spark, name)))
    assert most <= 6 * 3
    assert held(spark, name) == want(200, 1)
    assert rows(tables.fresh(spark, name).select("epoch", "v")) == rows(epochs.read(spark, name).select("epoch", "v"))


def test_a_repeated_micro_batch_replaces_its_rows(spark, name):
    for e in (0, 1, 2, 2, 3, 4, 4):
        epochs.append(batch(spark, e), name, e, width=2)
    assert held(spark, name) == want(5)
    assert epochs.spans(spark, name) == [(0, 3), (4, 4)]


def test_empty_micro_batches(spark, name):
    for e in range(9):
        epochs.append(batch(spark, e, 0 if e % 3 else 1), name, e, width=2)
    assert held(spark, name) == [(0, 0), (3, 30), (6, 60)]


def test_a_fold_that_broke_off_is_finished_by_the_next(spark, name, monkeypatch):
    with monkeypatch.context() as broken:
        broken.setattr(tables, "drop_partitions", lambda *_: 0)
        for e in range(3):
            epochs.append(batch(spark, e), name, e, width=2)
    assert epochs.covered(epochs.spans(spark, name)) == [(0, 0), (1, 1)]
    assert held(spark, name) == want(3)
    for e in range(3, 5):
        epochs.append(batch(spark, e), name, e, width=2)
    assert epochs.spans(spark, name) == [(0, 3), (4, 4)] and held(spark, name) == want(5)


def test_another_checkpoint_is_refused(spark, name):
    for e in range(3):
        epochs.append(batch(spark, e), name, e, width=2)
    with pytest.raises(ValueError):
        epochs.append(batch(spark, 0), name, 0, width=2)
    assert held(spark, name) == want(3)
