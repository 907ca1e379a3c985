"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its single words (as they stand, and with A-Z lowered), its pairs of words, and single
shapes and pairs of shapes: a shape is which kinds of characters a word has, and whether it repeats the word before it.
They are hashed into 2**bits weights, each with the value log(1 + count), scaled to length 1. Training goes over a bounded sample of labelled texts
(`most` rows, in hash order), in one task, with FTRL-proximal updates (per-coordinate rates, L1 and L2). The model is
2**bits numbers whatever the corpus's size; scoring is a sparse dot product where the texts are read.

Defined cases: a null or empty text has no feature but the bias. Without labels of both kinds the score of every text is
the labels' mean (0.5 without any). Rows with one id are scored each. Other columns are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .labelled import remainder, sample
from .text import LOWER, Words, mix, pack, slices, text_bytes, window_hashes, within

BITS = 18
#: Labelled rows that training sees at most.
MOST = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4


#: Kinds of characters, as bits of a shape.
KINDS = np.full(256, 2, dtype=np.uint8)
for _bit, _characters in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, b"0123456789"), (8, b".,;:'\"-()"), (16, b"!?"), (32, b"#$%&*@^~"),
                          (64, b"|<>{}[]\\/_=+`"), (0, b" \t\n\v\f\r")):
    KINDS[list(_characters)] = _bit


def shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The shape of every word, as a number below 256."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kinds = np.bitwise_or.reduceat(KINDS[words.data], words.starts)
    again = np.zeros(len(hashes), dtype=np.uint8)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return (kinds | again << 7).astype(np.uint64)


def features(column, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text; the last index is the bias."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets)
    plain, low = words.hashes(), Words(LOWER[data], offsets).hashes()
    pairs = window_hashes(low, 2)
    docs, size = len(words.counts), np.uint64(64 - bits)
    ok = within(words.counts, 2)
    shape = shapes(words, low)
    two = (shape[:-1] << np.uint64(8) | shape[1:])[ok] + np.uint64(1 << 8)
    first = words.doc[:len(pairs)][ok]
    doc = np.concatenate([words.doc, words.doc, words.doc, first, first])
    index = np.concatenate([low, mix(plain), mix(shape + np.uint64(1)), pairs[ok], mix(two)]) >> size
    index = index.astype(np.int64)
    key, count = np.unique(doc << bits | index, return_counts=True)
    value = np.log1p(count)
    owner = key >> bits
    norm = np.sqrt(np.bincount(owner, value * value, minlength=docs))
    value /= np.maximum(norm[owner], 1e-12)
    index = key & ((1 << bits) - 1)
    cuts = np.searchsorted(owner, np.arange(docs + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.append(index[a:b], 1 << bits), np.append(value[a:b], 1.0)


def _examples(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            rows = list(features(batch.column("_text"), bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("turn"), batch.column("doc_id"),
                 pa.array([pack(i.astype(np.int32)) for i, _ in rows], pa.binary()),
                 pa.array([pack(v.astype(np.float32)) for _, v in rows], pa.binary())],
                ["label", "turn", "doc_id", "indices", "values"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(examples, size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after FTRL-proximal updates over (label, indices, values)."""
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for label, index, value in examples:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            gradient = (sigmoid(w @ value) - label) * value
            square = gradient * gradient
            z[index] = zi + gradient - (np.sqrt(ni + square) - root) / alpha * w
            n[index] = ni + square
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _train(table: pa.Table, bits, epochs, alpha, beta, l1, l2) -> pa.Table:
    table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    labels = np.asarray(table["label"]).astype(float)
    size = (1 << bits) + 1
    weights = np.zeros(size)
    if 0 < labels.sum() < len(labels):
        examples = [(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float)) for y, i, v in
                    zip(labels, table["indices"].to_pylist(), table["values"].to_pylist(), strict=True)]
        weights = ftrl(examples, size, epochs, alpha, beta, l1, l2)
    else:
        weights[-1] = 40.0 * (2 * labels[0] - 1)
    return pa.table({"weights": pa.array([pack(weights.astype(np.float32))], pa.binary())})


def train(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS,
          epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """The weights. `labelled` (doc_id, label, turn) is bounded: it is sent to the readers of the documents."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(labelled), "doc_id")
    examples = rows.select("label", "turn", "doc_id", "_text").mapInArrow(
        functools.partial(_examples, bits=bits), "label int, turn bigint, doc_id bigint, indices binary, values binary")
    model = examples.groupBy(F.lit(0).alias("all")).applyInArrow(
        frames.on_group(_train, bits=bits, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2), "weights binary").first()
    return np.frombuffer(bytes(model[0]), np.float32) if model else np.zeros((1 << bits) + 1, np.float32)


def _score(batches: Iterator[pa.RecordBatch], weights, bits: int) -> Iterator[pa.RecordBatch]:
    weights = weights.value.astype(float)
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            scores = [float(sigmoid(weights[i] @ v)) for i, v in features(batch.column("_text"), bits)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_text"), batch.column("_rest"), pa.array(scores, pa.float64())],
                                             schema=batch.schema.append(pa.field("score", pa.float64())))


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """All columns of `docs` and the score."""
    source = frames.carried(docs, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(functools.partial(_score, weights=sent, bits=bits), schema)
    return scored.select(F.col("_id").alias(doc_id), F.col("_text").alias(text), *frames.others(docs, doc_id, text),
                         *frames.unless_taken(docs, "score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(docs, sample(labels, "quality", MOST, remainder(F.col("doc_id"), 4) != 2))
    out = score(docs, weights)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))
