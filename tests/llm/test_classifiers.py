import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, module, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    return np.array([r[label] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def area(y, score):
    rank = np.argsort(np.argsort(score, kind="stable"))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    y, score, predicted = held_out(spark, module, label)
    assert len(y) > 700 and ((0 <= score) & (score <= 1)).all()
    assert area(y, score) > 0.98 and (y == predicted).mean() > 0.97


DOCS = [(1, None, "x", 0.1), (2, "", "x", 0.2), (3, "plain words here", None, None), (3, "plain words here", None, None),
        (None, "you idiot", "x", 0.3), (5, "long " * 100_000, "x", 0.4)]
SCHEMA = "doc_id bigint, text string, turn string, score double"


@pytest.mark.parametrize("labels", [[], [(3, None)], [(3, 1)], [(3, 0), (5, 0)], [(3, 1), (5, 0), (3, 1), (None, 1), (99, 1)]])
def test_quality_of_odd_rows(spark, labels):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    chosen = labelled.sample(spark.createDataFrame(labels, "doc_id bigint, quality int"), "quality", 10, F.lit(True))
    got = quality.score(docs, quality.train(docs, chosen))
    assert got.columns == [*docs.columns, "score_"]
    assert all(0 <= r.score_ <= 1 for r in got.collect()) and got.count() == len(DOCS)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), chosen)).count() == 0


@pytest.mark.parametrize("labels", [[], [(3, 1)], [(3, 0), (5, 0)], [(3, 1), (5, 0), (3, 1), (None, 1), (1, 0), (2, 0)]])
def test_toxicity_of_odd_rows(spark, labels):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    chosen = labelled.sample(spark.createDataFrame(labels, "doc_id bigint, toxic int"), "toxic", 10, F.lit(True))
    got = toxicity.score(docs, toxicity.train(docs, chosen))
    assert got.columns == [*docs.columns, "score_"]
    assert all(0 <= r.score_ <= 1 for r in got.collect()) and got.count() == len(DOCS)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), chosen)).count() == 0


def test_sample_is_bounded_and_the_same(spark):
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    fold = labelled.remainder(F.col("doc_id"), 5) != 0
    first = labelled.sample(labels, "toxic", 50, fold).collect()
    assert len(first) == 50 and first == labelled.sample(labels.repartition(7), "toxic", 50, fold).collect()


def test_trees_and_calibration():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    p = 1 / (1 + np.exp(-(3 * (x[:, 0] > 0.3) * (x[:, 1] < 0) - 1.5)))
    y = (r.random(3000) < p).astype(float)
    model = toxicity.grow(x[:2000], y[:2000], 40, 3, 0.2, 32, 5)
    raw = toxicity.margins(model, x[2000:])
    assert area(y[2000:], raw) > 0.7
    at, value = toxicity.isotonic(raw, y[2000:])
    assert at == sorted(at) and value == sorted(value)
    assert abs(np.interp(raw, at, value).mean() - y[2000:].mean()) < 0.05


def test_obfuscated_words_are_found():
    import pyarrow as pa

    rows = toxicity.features(pa.array(["you are an 1d!0t, mate", "you are an idiot", "a calm text of words"]), (np.zeros(0, np.uint64), np.zeros(0)))
    given, near = toxicity.NAMES.index("given_count"), toxicity.NAMES.index("near")
    assert rows[:, given].tolist() == [1, 1, 0] and rows[:, near].tolist() == [1, 1, 0]
