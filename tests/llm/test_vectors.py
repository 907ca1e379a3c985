"""Embedding operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import embedding_dedup, nearest

SCHEMA = "vec_id bigint, embedding array<float>"


def vectors(seed, n, size=24, groups=12, noise=0.12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, size))
    x = centres[r.integers(0, groups, n)] + noise * r.normal(size=(n, size)) * r.integers(1, 9, n)[:, None]
    return (x * r.uniform(0.5, 2, n)[:, None]).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def brute_links(x, threshold):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= threshold
    np.fill_diagonal(links, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return links.sum(axis=1), label
        label = new


@pytest.mark.parametrize("threshold, block", [(0.9, 4096), (0.9, 37), (0.97, 50)])
def test_links_and_components(spark, threshold, block):
    x = vectors(1, 600)
    x[500:560] = x[3]  # copies
    x[560:] = x[7] * np.linspace(0.5, 3, 40, dtype=np.float32)[:, None]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame(spark, x).repartition(5), threshold=threshold, block=block).collect())
    links, label = brute_links(x, threshold)
    assert got == [(i, int(links[i]), int(label[i]), bool(label[i] == i)) for i in range(len(x))]
    assert links.max() >= 60


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (10, [5.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.9, 0.1]), (11, [0.9, 0.1])]
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", tree int")


def test_odd_vectors(spark):
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(odd(spark)).collect()), key=str)
    linked = {r[0]: r[1:] for r in got}
    assert len(got) == 13
    assert linked[1] == (2, 1, True) and linked[2] == (2, 1, False) and linked[11] == (2, 1, False)
    assert linked[9] == (1, 9, True) and linked[10] == (1, 9, False)
    assert all(linked[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8)) and linked[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_extreme_lengths(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1.7e308, 1.7e308]), (6, [5e-324, 5e-324]),
            (7, [1.0, -1.0]), (8, [1e-320, -1e-320]), (9, [1e300, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(i, 5, 1, i == 1) for i in range(1, 7)] + [(7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]


def brute_nearest(x, q, k):
    score = x.astype(float) @ x[q].astype(float)
    score[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -score))[:k], score


@pytest.mark.parametrize("shard", [8192, 300])
def test_recall(spark, shard):
    x = vectors(2, 1500, noise=0.3)
    got = nearest.nearest(frame(spark, x), F.col("vec_id") % 20 == 0, 20, shard=shard).collect()
    hits = total = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        best, score = brute_nearest(x, q, 20)
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(r.score, r.vec_id) for r in own] == sorted(((r.score, r.vec_id) for r in own), key=lambda p: (-p[0], p[1]))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    x = vectors(3, 300)
    x[100:250] = x[0] * 3
    got = nearest.nearest(frame(spark, x), F.col("vec_id") == 120, 5).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]


def test_few_and_odd_candidates(spark):
    got = nearest.nearest(odd(spark), F.lit(True), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [
        (1, 1, 2), (1, 2, 11), (2, 1, 1), (2, 2, 11), (9, 1, 10), (10, 1, 9), (11, 1, 2), (11, 2, 1)]
    assert nearest.nearest(odd(spark).limit(0), F.lit(True), 20).count() == 0


def recall(got, x, first_query, k=20):
    """The share of the true neighbours that were found, judged by score."""
    own = {}
    for r in got:
        own.setdefault(r.query_id, []).append(r.score)
    hits = total = 0
    for q in range(0, len(x), first_query):
        best, score = brute_nearest(x, q, k)
        worst = score[best[-1]]
        hits += min(k, sum(s >= worst - 1e-9 * abs(worst) for s in own[q]))
        total += len(best)
    return hits / total


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_recall_of_a_full_shard(spark, seed):
    x = vectors(seed, 8000, noise=0.3)
    got = nearest.nearest(frame(spark, x), F.col("vec_id") % 100 == 0, 20).collect()
    assert recall(got, x, 100) >= 0.9


def test_recall_beside_very_long_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 8))
    x[1999] *= 1e9
    x[1998] *= 1e4
    x[1997] *= 1e-9
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, [1e200] * 8), (5001, [1e-200] * 8)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    own = [r for r in got if r.query_id < 2000]
    all_ = np.concatenate([x, np.full((1, 8), 1e200), np.full((1, 8), 1e-200)])
    hits = 0
    for q in range(0, 2000, 20):
        score = all_ @ x[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in own if r.query_id == q} & {int(i) if i < 2000 else int(i) + 3000 for i in np.argsort(-score)[:20]})
    assert hits / 2000 >= 0.9
    assert len([r for r in got if r.query_id == 5000]) == 20
