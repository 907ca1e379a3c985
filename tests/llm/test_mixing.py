from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, start int"


def corpus():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "s%d" % (i % 7) if i % 3 else "hot", 0) for i in range(600)]
    return rows + [(1000, "x " * 5000, "s1", 0), (1001, None, "s2", 0), (1002, "", None, 0), (1003, "a b c", None, 0),
                   (1003, "a b c", None, 0), (None, "q r", "tiny", 0), (1004, "", "empty", 0)]


def fair(sizes, weights, repeats):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("block", [50_000, 20])
def test_schedule(spark, block):
    rows = corpus()
    got = mixing.schedule(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows)
    want = fair(sizes, mixing.WEIGHTS, 3)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert want[s] - 1.01 <= taken[s] <= want[s] + 1e-6
    again = mixing.schedule(spark.createDataFrame(rows[::-1], SCHEMA), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = mixing.schedule(docs)
    want = {r.source: r.words for r in plan.groupBy("source").agg(F.sum("taken").alias("words")).collect() if r.words}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = mixed.select("source", mixing.words(F.col("text")).alias("n")).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.source] += r.n
    assert dict(got) == want
    # The order interleaves the sources: each tenth of the mix has about a tenth of the largest.
    words = [(r.source, r.n) for r in rows]
    tenth = sum(n for s, n in words[:len(words) // 2] if s == "hot")
    assert 0.35 < tenth / want["hot"] < 0.65


@pytest.mark.parametrize("block", [50_000, 20])
def test_queue(spark, block):
    """Sorted by finish time over all sources, cut where the budget ends."""
    got = mixing.queue(spark.createDataFrame(corpus(), SCHEMA).repartition(3), block=block).collect()
    taken = [r for r in got if r.taken]
    assert [r.finish for r in taken] == sorted(r.finish for r in taken) and max(r.finish for r in taken) <= 1 + 1e-9
    assert not any(r.taken for r in got[len(taken):])
    at = 0
    for r in taken:
        assert r.position == at
        at += r.taken
    budget = sum(mixing_size(text) for _, text, _, _ in corpus())
    assert budget - len({r.source for r in taken}) <= at <= budget


def mixing_size(text):
    return len((text or "").split())


def test_mix_of_rows_that_share_an_id(spark):
    """Rows of one id and text, and without an id, keep their other columns; a map is one of them."""
    rows = [(None, "a b", "s", {"k": 1}), (None, "a b", "s", {"k": 2}), (None, "c d e", "s", None), (7, "f", "t", {"k": 3})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra map<string,int>")
    mixed = mixing.mix(docs, weights=(1.0,)).collect()
    whole = [(r.doc_id, r.text, r.source, r.extra) for r in mixed if r.text in {t for _, t, _, _ in rows}]
    assert {str(r.extra) for r in mixed if r.text == "a b"} == {"{'k': 1}", "{'k': 2}"}
    assert all((i, t, s, e) in rows for i, t, s, e in whole)


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.schedule(docs).count() == 0 and mixing.mix(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 1), (2, " ", None, 1)], SCHEMA)
    assert [r.taken for r in mixing.schedule(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0
