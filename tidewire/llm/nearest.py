"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Nearness is the inner product. Vectors are divided into bands of length, each four times as long as the one below, so that no
vector makes others look like one point. Within a shard of a band vectors get one more coordinate that gives all of them the
length of its longest, so the largest product is the smallest angle and a graph over angles answers it; queries have 0 there.
Vectors are scaled by powers of two before anything is squared.

Rows of a band are dealt to shards of about `shard` vectors by a hash of the id. A shard's graph is built like that of sequential
insertion with a perfect search: each vector, in hash order, is linked to those of its nearest predecessors that are not
nearer to one another (the usual diversity rule), both ways, on every layer up to its own. Predecessors are found
by block products. When a vector's links are pruned, the link to its nearest predecessor stays, and half of the width is
held for vectors whose nearest predecessor it is: that tree keeps a layer connected. Graphs are stored as
flat arrays (vectors, neighbours of fixed width per layer) in a written table, so a lost executor rebuilds nothing.

How wide a search has to be depends on the vectors, so it is measured: a finished graph answers for `PROBES` of its own
vectors, and the width is doubled until they find the share `RECALL` of what all products of the shard give.

Every query is searched in every shard: blocks of `queries` queries meet the shards as rows, not as pairs of vectors.
Graphs work in single precision; scores are products of the original vectors in double precision (a sum of infinities that is
no number counts as minus infinity).

Copies: of vectors that are equal only the k + 1 smallest ids are indexed; no other can be among a query's k nearest, as
these come before it at the same score. A third of all rows being one vector is k + 1 rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; of rows
with one id the smallest vector counts; vectors of different lengths do not meet. Fewer candidates: all found.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .components import stored
from .vectors import blob, matrix, one_each, unblob

#: Links of a vector on an upper layer (twice as many on the lowest); candidates for links; least width of a search.
LINKS, CANDIDATES, WIDTH = 16, 64, 128
#: Vectors in a shard on average; queries that meet a shard at once.
SHARD, QUERIES = 8192, 4096
#: Queries that search together, and rows each of them expands at a step.
TOGETHER, STEP = 128, 8
#: Vectors that measure a graph, and the share of their neighbours they have to find.
PROBES, RECALL = 64, 0.97
NONE = -1


def layers_of(n: int, links: int) -> np.ndarray:
    """The top layer of each of n vectors: each layer holds one in `links` of the one below."""
    random = np.random.default_rng(n)
    return np.minimum((-np.log(random.random(n)) / np.log(links)).astype(int), 12)


def chosen(order: np.ndarray, near: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Of candidates in falling nearness: those nearer to the vector than to any chosen one; the best others fill up."""
    out: list[int] = []
    nearest = np.full(len(order), -np.inf)  # of each candidate to the chosen ones
    for k in range(len(order)):
        if near[k] > nearest[k]:
            out.append(k)
            if len(out) >= most:
                return out
            np.maximum(nearest, among[k], out=nearest)
    taken = set(out)
    return out + [k for k in range(len(order)) if k not in taken][:max(0, most // 2 - len(out))]


def layer_graph(x: np.ndarray, links: int, most: int, candidates: int) -> np.ndarray:
    """Neighbours of each row of x (unit vectors, in order of insertion), `most` wide, filled up with NONE."""
    n = len(x)
    neighbours: list[list[int]] = [[] for _ in range(n)]
    kept = np.full(n, NONE)  # the nearest predecessor
    for first in range(0, n, 512):
        rows = np.arange(first, min(first + 512, n))
        products = x[rows] @ x[:rows[-1] + 1].T
        products[np.arange(rows[-1] + 1)[None, :] >= rows[:, None]] = -np.inf
        k = min(candidates, products.shape[1])
        part = np.argpartition(-products, k - 1, axis=1)[:, :k]
        for r, i in enumerate(rows):
            if i == 0:
                continue
            order = part[r][products[r, part[r]] > -np.inf]
            order = order[np.argsort(-products[r, order], kind="stable")]
            kept[i] = order[0]
            for c in chosen(order, products[r, order], x[order] @ x[order].T, links):
                neighbours[i].append(int(order[c]))
                neighbours[order[c]].append(int(i))
    flat = np.full((n, most), NONE, np.int32)
    successors: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        successors[kept[i]].append(i)
    for i, own in enumerate(neighbours):
        if len(own) > most:
            tree = ([int(kept[i])] if i else []) + successors[i][:most // 2 - 1]
            order = np.array([j for j in own if j not in tree], dtype=int)
            near = x[order] @ x[i]
            best = np.argsort(-near, kind="stable")[:4 * most]
            order, near = order[best], near[best]
            own = tree + [int(order[c]) for c in chosen(order, near, x[order] @ x[order].T, most - len(tree))]
        flat[i, :len(own)] = own
    return flat


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """For each query the nearest rows found from its entries, `width` of them, NONE where there are fewer; `entries` has a row
    for each query and NONE where it has no more.

    All queries of a block step together: each expands the best `STEP` rows of its `width` best that it has not expanded yet, until
    none is left.
    """
    count, n = len(queries), len(x)
    best = np.full((count, width), NONE, np.int64)
    near = np.full((count, width), -np.inf, np.float32)
    open_ = np.zeros((count, width), bool)
    seen = np.zeros((count, n + 1), bool)
    seen[:, NONE] = True  # the last column stands for no row

    def meet(rows, met):
        """Rows of x that some queries meet: the new ones enter the best."""
        new = np.empty(met.shape, bool)
        for k in range(0, met.shape[1], graph.shape[1]):  # one list of neighbours has no row twice
            part = met[:, k:k + graph.shape[1]]
            new[:, k:k + graph.shape[1]] = ~seen[rows[:, None], part]
            seen[rows[:, None], part] = True
        r, c = np.nonzero(new)
        value = np.full(met.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("ij,ij->i", x[met[r, c]], queries[rows[r]])
        value = np.concatenate([near[rows], value], axis=1)
        at = np.argpartition(-value, width - 1, axis=1)[:, :width]
        near[rows] = np.take_along_axis(value, at, 1)
        best[rows] = np.take_along_axis(np.concatenate([best[rows], met], axis=1), at, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], axis=1), at, 1)

    meet(np.arange(count), entries)
    step = min(STEP, width)
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return np.where(near > -np.inf, best, NONE)
        left = np.where(open_[rows], near[rows], -np.inf)
        at = np.argpartition(-left, step - 1, axis=1)[:, :step]
        chosen_ = np.where(np.take_along_axis(left, at, 1) > -np.inf, np.take_along_axis(best[rows], at, 1), NONE)
        open_[rows[:, None], at] = False
        meet(rows, np.where(chosen_[:, :, None] >= 0, graph[chosen_], NONE).reshape(len(rows), -1))


def _build(table: pa.Table, links: int, candidates: int, width: int, k: int) -> pa.Table:
    """A shard's rows as one row: ids, vectors, the width of a search, and for each layer its members and their neighbours."""
    table = table.sort_by([("turn", "ascending"), ("id", "ascending")])
    x = matrix(table["vector"])
    unit = augmented(x, table["band"][0].as_py())
    top = layers_of(len(x), links)
    top[0] = max(top.max(), 0)
    members, graphs = [], []
    for layer in range(top.max() + 1):
        own = np.flatnonzero(top >= layer)
        members.append(own.astype(np.int32))
        graphs.append(layer_graph(unit[own], links, links * (2 if layer == 0 else 1), candidates))
    width = measured_width(unit, members, graphs, width, k)
    ids = np.asarray(table["id"].combine_chunks())
    return pa.table({
        **{c: table[c].slice(0, 1).cast(pa.int32()) for c in ("size", "band", "shard")}, "n": pa.array([len(x)], pa.int32()),
        "width": pa.array([width], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([blob(x)], pa.binary()),
        "members": pa.array([[m.tobytes() for m in members]], pa.list_(pa.binary())),
        "graphs": pa.array([[g.tobytes() for g in graphs]], pa.list_(pa.binary()))})


def augmented(x: np.ndarray, band: int) -> np.ndarray:
    """Vectors of one band with one more coordinate that gives all of them one length, as unit vectors."""
    x = np.ldexp(x, -2 * band)
    square = (x ** 2).sum(axis=1)
    longest = square.max()
    return (np.concatenate([x, np.sqrt(longest - square)[:, None]], axis=1) / np.sqrt(longest)).astype(np.float32)


def direction(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, with 0 behind."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)


def descend(layers: list[np.ndarray], members: list[np.ndarray], graphs: list[np.ndarray], queries: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For some queries after another the rows of the lowest layer found."""
    for k in range(0, len(queries), TOGETHER):
        some = queries[k:k + TOGETHER]
        entry = np.zeros((len(some), 1), np.int64)  # the first vector is on every layer
        for layer in range(len(layers) - 1, 0, -1):
            at = search(layers[layer], graphs[layer], some, entry, 4)
            entry = np.where(at >= 0, np.searchsorted(members[layer - 1], members[layer][at]), NONE)
        yield search(layers[0], graphs[0], some, entry, width)


def measured_width(unit: np.ndarray, members: list[np.ndarray], graphs: list[np.ndarray], width: int, k: int) -> int:
    """The least width, by doubling, with which the shard's first vectors (in hash order) find their k nearest."""
    layers, n, k = [unit[m] for m in members], len(unit), min(k + 1, len(unit))
    queries = unit[:PROBES].copy()
    queries[:, -1] = 0
    products = queries @ unit.T
    least = np.partition(products, n - k, axis=1)[:, n - k]
    width = max(width, k)
    while width < n:
        found = np.concatenate(list(descend(layers, members, graphs, queries, width)))
        reached = (found >= 0) & (np.take_along_axis(products, np.maximum(found, 0), 1) >= least[:, None])
        hits = np.minimum(reached.sum(axis=1), k).sum()
        if hits >= RECALL * k * len(queries):
            break
        width *= 2
    return min(width, n)


def _found(table: pa.Table, k: int) -> pa.Table:
    row = {c: table[c][0].as_py() for c in table.column_names}
    ids, x = np.frombuffer(row["ids"], np.int64), unblob(row["vectors"], row["n"])
    unit = augmented(x, row["band"])
    members = [np.frombuffer(m, np.int32) for m in row["members"]]
    graphs = [np.frombuffer(g, np.int32).reshape(len(m), -1) for m, g in zip(members, row["graphs"], strict=True)]
    layers = [unit[m] for m in members]
    queries, query_ids = unblob(row["queries"], row["m"]), np.frombuffer(row["query_ids"], np.int64)
    out_q, out_v, out_s = [], [], []
    found = (best for some in descend(layers, members, graphs, direction(queries), row["width"]) for best in some)
    for query, best, own in zip(queries, found, query_ids, strict=True):
        best = best[best >= 0]
        best = best[ids[best] != own]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,j->i", x[best], query)
        score = np.where(np.isnan(score), -np.inf, score)
        order = np.lexsort((ids[best], -score))[:k]
        out_q.append(np.full(len(order), own))
        out_v.append(ids[best[order]])
        out_s.append(score[order])
    parts = [np.concatenate(o) if o else np.zeros(0) for o in (out_q, out_v, out_s)]
    return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Queries of one size as rows of at most `size`."""
    for batch in batches:
        sizes = np.asarray(batch.column("size"))
        for own in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == own)))
            for k in range(0, rows.num_rows, size):
                part = rows.slice(k, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([np.asarray(part.column("id")).tobytes()], pa.binary()),
                     pa.array([blob(matrix(part.column("vector")))], pa.binary())], ["size", "m", "query_ids", "queries"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `size` and `band`: the number of components, and the power of four below the length, found without squaring what could
    overflow."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = np.diff(np.asarray(vectors.offsets)).astype(np.int32)
        x = np.asarray(vectors.flatten(), dtype=float)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(sizes) else np.zeros(0, int)
        largest = np.maximum.reduceat(np.abs(x), starts) if len(sizes) else np.zeros(0)
        square = np.add.reduceat((x / np.repeat(largest, sizes)) ** 2, starts) if len(sizes) else np.zeros(0)
        band = np.floor((np.log2(largest) + np.log2(square) / 2) / 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(band)], [*batch.schema.names, "size", "band"])


def nearest(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD,
            links: int = LINKS, candidates: int = CANDIDATES, width: int = WIDTH, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where `is_query` (a condition on `vec_id`) its k nearest others."""
    everyone = stored(one_each(df, vec_id, vector).mapInArrow(_banded, "id bigint, vector array<double>, size int, band int"), "vectors")
    copies = Window.partitionBy("vector").orderBy("id")
    indexed = everyone.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    # A row for each length of vectors and power of four.
    bands = stored(everyone.groupBy("size", "band").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "bands")

    dealt = indexed.withColumn("turn", F.xxhash64(F.lit(11), F.col("id"))).join(bands, ["size", "band"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), F.col("id")), "shards").cast("int")).drop("shards")
    key = ["size", "band", "shard"]
    graphs = stored(dealt.groupBy(*key).applyInArrow(
        frames.on_group(_build, links=links, candidates=candidates, width=width, k=k),
        "size int, band int, shard int, n int, width int, ids binary, vectors binary, members array<binary>, graphs array<binary>"), "graphs")

    asking = everyone.withColumnRenamed("id", vec_id).where(is_query).withColumnRenamed(vec_id, "id").select("id", "vector", "size")
    blocks = asking.mapInArrow(functools.partial(_blocks, size=queries), "size int, m int, query_ids binary, queries binary")
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "queries")
    pairs = blocks.select("size", "block").join(bands, "size").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    tasks = pairs.drop("shards").join(graphs, key).join(blocks.drop("size"), "block")
    found = tasks.groupBy(*key, "block").applyInArrow(frames.on_group(_found, k=k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
