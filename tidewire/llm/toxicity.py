"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of three lexicons, how near their words stand to words of the second person, rates of
capitals, exclamation and other marks, of obfuscated words (letters with digits or signs among them) and of repeated
words, and its length. One lexicon is given (common insults), two are learned: words, and word beginnings, that are
far more frequent in texts labelled toxic. Words are compared with A-Z lowered, look-alike signs replaced (``1d!0t``)
and all other signs dropped.

Training sees a bounded sample of labelled texts (`most` rows in hash order), cut in three so that no part flatters the next:
`shares` of it learn the lexicons, grow the trees, and calibrate. Lexicon counts are a grouped aggregate; trees are grown in
one task from `most` rows of some twenty numbers. The model is a few kilobytes; texts are scored where they are read.

Defined cases: a null or empty text has all-zero features and is scored like any other. Without labels of both kinds every
score is the labels' mean (0 without any). Rows with one id are scored each. Other columns are carried along.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .labelled import remainder, sample
from .text import LOWER, Words, grouped, mix, pack, range_hashes, slices, text_bytes

#: Labelled rows that training sees at most, and how they are cut: lexicons, trees, calibration.
MOST, SHARES = 20_000, (0.4, 0.4, 0.2)
#: Entries of a learned lexicon at most; toxic texts an entry must occur in; how much more often than in others.
ENTRIES, LEAST, RATIO = 2000, 4, 6.0
#: Lengths of the word beginnings, in bytes.
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 8.0
#: Words that count as near.
NEAR = 4

INSULTS = """idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown clowns dumb
fool jerk garbage filth filthy ugly imbecile cretin vermin coward liar freak creep bastard pig parasite
idioten dumm dummkopf trottel abschaum versager widerlich erbärmlich wertlos
idiote imbécile crétin débile ordure minable pathétique pourriture
idiota estúpido estúpida imbécil basura escoria patético inútil asqueroso""".split()
SECOND_PERSON = """you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch
euer sie ihnen ti tus su usted ustedes vosotros""".split()

NAMES = ("given", "words", "stems", "weight", "given_count", "word_count", "stem_count", "near", "near_share", "capitals",
         "capital_words", "exclamations", "marks", "obfuscated", "digits", "repeated", "distinct", "mean_length", "n_words")

_PLAIN = LOWER.copy()
for _sign, _letter in zip(b"013457@$!|", b"oieastasii", strict=True):
    _PLAIN[_sign] = _letter
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[128:] = True
_USED = _LETTER[_PLAIN]
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b"013457@$")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0"):ord("9") + 1] = True


class Tokens:
    """Words without their signs: hashes of the whole and of each beginning."""

    def __init__(self, words: Words):
        self.words, data = words, words.data
        # Marks at the ends of a word are punctuation; those inside it, and digits anywhere, stand for letters.
        real = _LETTER[data]
        self.letters = np.concatenate([[0], np.cumsum(real)])
        real = real | _EDGE[data]
        before = np.concatenate([[0], np.cumsum(real)])
        first = np.searchsorted(before, before[words.starts], side="right") - 1
        last = np.searchsorted(before, before[words.ends], side="left")
        empty = before[words.ends] == before[words.starts]
        first, last = np.where(empty, words.starts, first), np.where(empty, words.starts, last)
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, first, 1)
        np.subtract.at(inside, last, 1)
        inside = np.cumsum(inside[:-1]) > 0
        use = inside & _USED[data]
        self.odd = inside & ~_LETTER[data] & (data != ord("-")) & (data != ord("'"))
        at = np.concatenate([[0], np.cumsum(use)])
        body = _PLAIN[data[use]]
        self.starts, self.ends = at[first], at[last]
        self.whole = range_hashes(body, self.starts, self.ends)
        self.stems = []
        for n in STEMS:
            cut = np.minimum(self.starts + n, self.ends)
            long = self.ends - self.starts >= n
            self.stems.append((mix(range_hashes(body, self.starts, np.maximum.accumulate(cut) if len(cut) else cut) + np.uint64(n)), long))


def listed(entries: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(entries)]))
    return np.unique(Tokens(Words(data, offsets)).whole)


def _weights(hashes: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(entries):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(entries, hashes), len(entries) - 1)
    return np.where(entries[at] == hashes, weights[at], 0.0)


def features(column, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of NAMES per text; `lexicon`: sorted hashes and their weights."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets)
    tokens = Tokens(words)
    docs, doc = len(words.counts), words.doc
    n = np.maximum(words.counts, 1)

    def per_doc(x):
        return np.bincount(doc, x, minlength=docs) if len(x) else np.zeros(docs)

    def bytes_of(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    given = np.isin(tokens.whole, listed(INSULTS)) if len(words) else np.zeros(0, bool)
    learned = _weights(tokens.whole, *lexicon)
    stems = np.zeros(len(words))
    for hashes, long in tokens.stems:
        stems = np.maximum(stems, np.where(long, _weights(hashes, *lexicon), 0.0))
    hit = given | (learned > 0) | (stems > 0)
    person = np.isin(tokens.whole, listed(SECOND_PERSON)) if len(words) else np.zeros(0, bool)
    near = np.zeros(len(words), bool)
    for d in range(1, NEAR + 1):
        same = doc[d:] == doc[:-d]
        near[d:] |= person[:-d] & same
        near[:-d] |= person[d:] & same
    near &= hit
    again = np.zeros(len(words), bool)
    again[1:] = (tokens.whole[1:] == tokens.whole[:-1]) & (doc[1:] == doc[:-1])
    key = np.unique(np.stack([doc.astype(np.uint64), tokens.whole]), axis=1)[0].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    letters = np.maximum(bytes_of(_LETTER[data]), 1)
    size = np.maximum(np.diff(offsets), 1)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    odd = np.concatenate([[0], np.cumsum(tokens.odd)])
    shout = (upper[words.ends] - upper[words.starts] >= 3)
    hits = per_doc(hit)
    columns = (
        per_doc(given) / n, per_doc(learned > 0) / n, per_doc(stems > 0) / n, per_doc(np.maximum(learned, stems)) / n,
        per_doc(given), per_doc(learned > 0), per_doc(stems > 0), per_doc(near), per_doc(near) / np.maximum(hits, 1),
        bytes_of(_UPPER[data]) / letters, per_doc(shout) / n, bytes_of(data == ord("!")) / size,
        bytes_of(~_LETTER[data] & (data > 32)) / size, per_doc((odd[words.ends] > odd[words.starts]) & (tokens.letters[words.ends] > tokens.letters[words.starts])) / n,
        bytes_of(_DIGIT[data]) / size, per_doc(again) / n, np.bincount(key, minlength=docs) / n,
        per_doc(words.ends - words.starts) / n, np.log1p(words.counts))
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if docs else np.zeros((0, len(NAMES)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and beginning: in how many toxic and other texts it occurs."""
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 22):
            tokens = Tokens(Words(*text_bytes(batch.column("_text"))))
            doc, label = tokens.words.doc, np.asarray(batch.column("label"))
            hashes = [tokens.whole, *[h[long] for h, long in tokens.stems]]
            docs = [doc, *[doc[long] for _, long in tokens.stems]]
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = grouped(h) | grouped(d) if len(h) else np.zeros(0, bool)
            h, y = h[new], label[d[new]]
            cuts = np.flatnonzero(grouped(h)) if len(h) else np.zeros(0, int)
            toxic = np.add.reduceat(y, cuts) if len(cuts) else cuts
            total = np.diff(np.append(cuts, len(h))) if len(cuts) else cuts
            yield pa.RecordBatch.from_arrays([pa.array(h[cuts].view(np.int64)), pa.array(toxic, pa.int64()), pa.array(total - toxic, pa.int64())],
                                             ["hash", "toxic", "other"])


def _rows(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            x = features(batch.column("_text"), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), batch.column("doc_id"),
                                              pa.array([pack(r) for r in x], pa.binary())], ["label", "turn", "doc_id", "features"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, leaf: float) -> dict:
    """Boosted trees for logistic loss; splits between quantiles. A tree is arrays in heap order: feature, threshold, value."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = {"base": float(np.log(mean / (1 - mean))), "trees": []}
    raw = np.full(len(y), model["base"])
    for _ in range(trees):
        p = sigmoid(raw)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), int)
        feature, threshold = np.full(2 ** depth - 1, -1), np.zeros(2 ** depth - 1)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best, choice = np.full(width, 1e-6), [None] * width
            for f in range(len(x.T)):
                if not len(edges[f]):
                    continue
                cell = (node - first) * bins + binned[f]
                live = node >= first
                sums = [np.bincount(cell[live], w[live], minlength=width * bins).reshape(width, bins) for w in (g, h, np.ones(len(y)))]
                left = [np.cumsum(s, axis=1)[:, :len(edges[f])] for s in sums]
                total = [s.sum(axis=1, keepdims=True) for s in sums]
                right = [t - s for t, s in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
                gain = np.where((left[2] >= leaf) & (right[2] >= leaf), gain, 0.0)
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], choice[k] = gain[k, at[k]], (f, at[k])
            for k, c in enumerate(choice):
                if c:
                    feature[first + k], threshold[first + k] = c[0], edges[c[0]][c[1]]
            f = feature[node]
            go = np.where(f >= 0, x[np.arange(len(y)), np.maximum(f, 0)] > threshold[node], False)
            node = 2 * node + 1 + go
        leaves = node - (2 ** depth - 1)
        value = rate * np.bincount(leaves, g, minlength=2 ** depth) / (np.bincount(leaves, h, minlength=2 ** depth) + 1)
        raw += value[leaves]
        model["trees"].append({"feature": feature.tolist(), "threshold": threshold.tolist(), "value": value.tolist()})
    return model


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.full(len(x), model["base"])
    for tree in model["trees"]:
        feature, threshold, value = (np.array(tree[k]) for k in ("feature", "threshold", "value"))
        node = np.zeros(len(x), int)
        for _ in range(int(np.log2(len(value)))):
            f = feature[node]
            node = 2 * node + 1 + np.where(f >= 0, x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node], False)
        raw += value[node - len(feature)]
    return raw


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """The rising function nearest to y (pool adjacent violators), as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean of y, weight, mean of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            n, v, d = blocks.pop()
            blocks.append([(m * w + n * v) / (w + v), w + v, (c * w + d * v) / (w + v)])
    return [b[2] for b in blocks], [b[0] for b in blocks]


def _train(table: pa.Table, trees, depth, rate, bins, leaf, shares) -> pa.Table:
    table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
    y = np.asarray(table["label"]).astype(float)
    x = np.stack([np.frombuffer(b, float) for b in table["features"].to_pylist()])
    cut = int(len(y) * shares[1] / (shares[1] + shares[2]))
    model = grow(x[:cut], y[:cut], trees, depth, rate, bins, leaf) if 0 < y[:cut].sum() < cut else \
        {"base": float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), "trees": []}
    late = y[cut:]
    model["calibration"] = isotonic(margins(model, x[cut:]), late) if 0 < late.sum() < len(late) else None
    return pa.table({"model": [json.dumps(model)]})


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    raw = margins(model, x)
    plain = sigmoid(raw)
    if not model["calibration"]:
        return plain
    at, value = model["calibration"]
    # A twentieth of the plain probability orders texts inside a flat piece.
    return 0.95 * np.interp(raw, at, value) + 0.05 * plain


def train(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", shares=SHARES) -> dict:
    """The model: lexicon, trees and calibration. `labelled` (doc_id, label, turn) is bounded: it is sent to the readers."""
    turns = labelled.select(F.percentile_approx("turn", shares[0], 10_000)).first()[0]
    rows = (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
            .join(F.broadcast(labelled), "doc_id").select("label", "turn", "doc_id", "_text"))
    if turns is None:
        return {"base": -35.0, "trees": [], "calibration": None, "lexicon": [], "weights": []}
    early = rows.where(F.col("turn") <= turns)
    total = labelled.where(F.col("turn") <= turns).agg(F.sum("label"), F.count("*")).first()
    odds = ((F.col("toxic") + 0.5) / (total[0] + 1.0)) / ((F.col("other") + 0.5) / (total[1] - total[0] + 1.0))
    entries = (early.mapInArrow(_counted, "hash bigint, toxic bigint, other bigint").groupBy("hash")
               .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= LEAST)
               .select("hash", F.least(F.log(odds), F.lit(6.0)).alias("weight"), "toxic").where(F.col("weight") >= float(np.log(RATIO)))
               .orderBy(F.desc(F.col("weight") * F.col("toxic")), "hash").limit(ENTRIES).collect())
    hashes = np.array([r["hash"] for r in entries], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, weights = hashes[order], np.array([r["weight"] for r in entries], float)[order]
    settings = {"trees": TREES, "depth": DEPTH, "rate": RATE, "bins": BINS, "leaf": LEAF, "shares": shares}
    late = rows.where(F.col("turn") > turns).mapInArrow(functools.partial(_rows, lexicon=(hashes, weights)),
                                                       "label int, turn bigint, doc_id bigint, features binary")
    trained = late.groupBy(F.lit(0).alias("all")).applyInArrow(frames.on_group(_train, **settings), "model string").first()
    model = json.loads(trained[0]) if trained else {"base": 0.0, "trees": [], "calibration": None}
    return {**model, "lexicon": hashes, "weights": weights}


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            scores = probabilities(model, features(batch.column("_text"), (model["lexicon"], model["weights"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             schema=batch.schema.append(pa.field("score", pa.float64())))


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` and the score."""
    source = frames.carried(docs, doc_id, text)
    model = {**model, "lexicon": np.asarray(model["lexicon"], np.uint64), "weights": np.asarray(model["weights"], float)}
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(functools.partial(_score, model=model), schema)
    return scored.select(F.col("_id").alias(doc_id), F.col("_text").alias(text), *frames.others(docs, doc_id, text),
                         *frames.unless_taken(docs, "score"))


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """A model from the labels that are not held out."""
    return train(docs, sample(labels, "toxic", MOST, remainder(F.col("doc_id"), 5) != 0), doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
