"""Near-duplicate embeddings: every pair with cosine >= threshold, by PCA-ordered tiled comparison.

Vectors are scaled by powers of two, then to length 1, and rotated to the principal axes of all of them (a sum of one small matrix per task), which
changes no cosine and puts most of each product into the leading dimensions. They are dealt to blocks along their leading
coordinates. Two blocks meet only if the distance of their centres and their radii allow the threshold. Inside such a
tile, products are accumulated over the leading dimensions first; what the rest can still add is at most the product of
the two suffix norms, and pairs that cannot reach the threshold any more are dropped before the next dimensions.
Pairs within a rounding error of the threshold are decided on the original vectors.

A tile does not list its pairs: it counts links and joins linked vectors to trees of its own, at most one row per vector.
A third of all vectors being near copies costs no more rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do null ids; of
rows with one id the smallest vector counts for all; vectors of another length than most link only among themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .components import components, stored
from .vectors import blob, matrix, one_each, unblob

THRESHOLD = 0.9
#: Vectors in a block, and rows of a tile compared at once.
BLOCK, STRIP = 4096, 256
#: Leading coordinates that order vectors, and their bits.
LEADING, LEVELS = 4, 5
SLACK = 1e-9
#: Dimensions after which a product is weighed against what the rest can still add.
STEPS = (16, 32, 48)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("vector"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([blob(total)], pa.binary())], ["moments"])


def axes(vectors: DataFrame, size: int) -> np.ndarray:
    """The principal axes as columns, the strongest first. Every task sends one size x size matrix."""
    sums = vectors.mapInArrow(_moments, "moments binary").toLocalIterator()
    total = sum((unblob(bytes(r[0]), size) for r in sums), np.zeros((size, size)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _keyed(batches: Iterator[pa.RecordBatch], rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An order that keeps vectors with like leading coordinates together: their bits, interleaved."""
    for batch in batches:
        x = matrix(batch.column("vector"))
        if len(x):
            lead = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation[:, :LEADING]
            cell = np.clip(((lead + 1) / 2 * (1 << LEVELS)).astype(int), 0, (1 << LEVELS) - 1)
            key = np.zeros(len(x), np.int64)
            for bit in range(LEVELS - 1, -1, -1):
                for d in range(lead.shape[1]):
                    key = key << 1 | (cell[:, d] >> bit & 1)
        else:
            key = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], [*batch.schema.names, "key"])


def _blocks(batches: Iterator[pa.RecordBatch], rotation: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """A sorted partition as rows of `size` vectors: ids, vectors, centre and radius of the rotated unit vectors."""
    rest: list[pa.RecordBatch] = []
    count = 0

    def made(table):
        x = matrix(table["vector"])
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation
        centre = unit.mean(axis=0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(axis=1).max()))
        return pa.RecordBatch.from_arrays(
            [pa.array([table.num_rows], pa.int32()), pa.array([blob(np.asarray(table["id"]).view(float))], pa.binary()),
             pa.array([blob(x)], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])],
            ["n", "ids", "vectors", "centre", "radius"])

    for batch in batches:
        rest.append(batch)
        count += batch.num_rows
        while count >= size:
            table = pa.Table.from_batches(rest)
            yield made(table.slice(0, size))
            rest, count = table.slice(size).to_batches(), count - size
    if count:
        yield made(pa.Table.from_batches(rest))


def _bounding(x: np.ndarray, done: int) -> np.ndarray:
    rest = np.sqrt((x[:, done:] ** 2).sum(axis=1, keepdims=True))
    return np.concatenate([x[:, :done], rest], axis=1).astype(np.float32)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the given pairs of rows, some at a time."""
    out = [np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]]) for k in range(0, len(i), 65536)]
    return np.concatenate(out) if out else np.zeros(0)


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rotated unit vectors whose product may reach the threshold, and their products."""
    size = a.shape[1]
    steps = [d for d in STEPS if d < size] + [size]
    done = steps[0]
    # With the suffix norm as one more coordinate a product is the bound itself; single precision, with room for its error.
    bounds = _bounding(a, done) @ _bounding(b, done).T
    near = bounds >= np.float32(threshold - 1e-4)
    if not near.any():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    if len(i) > near.size // 8:  # many left: whole rows are cheaper
        p = (a[:, :done] @ b[:, :done].T)[i, j]
    else:
        p = _products(a[:, :done], b[:, :done], i, j)
    for step in steps[1:]:
        if not len(i):
            break
        if len(i) > near.size // 8:
            p = p + (a[:, done:step] @ b[:, done:step].T)[i, j]
        else:
            p = p + _products(a[:, done:step], b[:, done:step], i, j)
        done = step
        left = np.sqrt(np.maximum((a[:, done:] ** 2).sum(axis=1), 0))[i] * np.sqrt(np.maximum((b[:, done:] ** 2).sum(axis=1), 0))[j]
        keep = p + left >= threshold - SLACK
        i, j, p = i[keep], j[keep], p[keep]
    return i, j, p


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of trees after joining i with j, pair by pair."""
    parent = np.arange(len(root))
    while True:
        r, s = parent[root[i]], parent[root[j]]
        apart = r != s
        if not apart.any():
            return parent[root]
        r, s = r[apart], s[apart]
        np.minimum.at(parent, np.maximum(r, s), np.minimum(r, s))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _tile(table: pa.Table, rotation: np.ndarray, threshold: float) -> pa.Table:
    row = {c: table[c][0].as_py() for c in table.column_names}
    same = row["a"] == row["b"]
    x, ids = unblob(row["vectors"], row["n"]), np.frombuffer(row["ids"], np.int64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y, n = x, len(x)
    if not same:
        y = unblob(row["vectors2"], row["n2"])
        y, ids = y / np.linalg.norm(y, axis=1, keepdims=True), np.concatenate([ids, np.frombuffer(row["ids2"], np.int64)])
    a, b = x @ rotation, y @ rotation
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in range(0, n, STRIP):
        i, j, p = close(a[k:k + STRIP], b, threshold)
        i = i + k
        if same:
            once = i < j
            i, j, p = i[once], j[once], p[once]
        unsure = np.abs(p - threshold) <= SLACK
        if unsure.any():
            p[unsure] = np.einsum("ij,ij->i", x[i[unsure]], y[j[unsure]])
        i, j = i[p >= threshold], j[p >= threshold] + (0 if same else n)
        if len(i):
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            root = joined(root, i, j)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    linked = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[linked], pa.int64()), "n_links": pa.array(links[linked], pa.int64()),
                     "tree": pa.array(least[root[linked]], pa.int64())})


def tiles(vectors: DataFrame, size: int, threshold: float, block: int) -> DataFrame:
    """(id, n_links, tree) of every vector with links in a tile, for vectors of one length."""
    rotation = axes(vectors, size)
    parts = frames.pieces(vectors.count(), block)
    keyed = vectors.mapInArrow(functools.partial(_keyed, rotation=rotation), "id bigint, vector array<double>, key bigint")
    ordered = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    made = ordered.mapInArrow(functools.partial(_blocks, rotation=rotation, size=block),
                              "n int, ids binary, vectors binary, centre array<double>, radius double")
    blocks = stored(made.withColumn("place", F.monotonically_increasing_id()), "blocks")
    # One row per block: numbered without gaps.
    numbered = blocks.select("place", "centre", "radius", F.row_number().over(Window.orderBy("place")).alias("block"))
    count = blocks.count()
    left = numbered.select(F.col("place").alias("a"), F.col("centre").alias("c"), F.col("radius").alias("r"),
                           F.explode(F.sequence(F.col("block"), F.lit(count))).alias("block"))
    apart = F.sqrt(F.aggregate(F.zip_with("c", "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    pairs = (left.join(numbered, "block").where((F.col("a") == F.col("place")) | (apart <= F.col("r") + F.col("radius") + reach))
             .select("a", F.col("place").alias("b")))
    tasks = (pairs.join(blocks.select(F.col("place").alias("a"), "n", "ids", "vectors"), "a")
             .join(blocks.select(F.col("place").alias("b"), F.col("n").alias("n2"), F.col("ids").alias("ids2"), F.col("vectors").alias("vectors2")), "b"))
    return tasks.groupBy("a", "b").applyInArrow(frames.on_group(_tile, rotation=rotation, threshold=threshold),
                                               "id bigint, n_links bigint, tree bigint")


def scaled(vector: str) -> Column:
    """The vector with a largest component from 1 to 2: divided by a power of two, which changes no cosine, so that no length
    overflows or vanishes."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(vector, lambda v: F.abs(v))))))
    return F.transform(vector, lambda v: v / power)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of `df`: id, n_links, component_id (smallest id reachable; its own without links), kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a positive cosine")
    vectors = stored(one_each(df, vec_id, vector).withColumn("vector", scaled("vector")), "vectors")
    found = None
    for (size,) in vectors.groupBy(F.size("vector").alias("size")).count().select("size").collect():
        part = tiles(vectors.where(F.size("vector") == size), size, threshold, block)
        found = part if found is None else found.union(part)
    ids = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"))
    if found is None:
        return ids.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    merged = components(found.select(F.col("id").alias("a"), F.col("tree").alias("b"))).toDF("id", "component_id")
    return (ids.join(counts, "id", "left").join(merged, "id", "left")
            .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id"))))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE sized AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings),
v AS (SELECT vec_id, list_transform(e, lambda x: x / pow(2, floor(log2(m)))) AS e FROM sized WHERE m > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT vec_id, b FROM reach JOIN link ON a = node),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(node) AS component_id, min(node) = vec_id AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
