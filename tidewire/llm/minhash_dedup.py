"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A document's set are its distinct runs of `shingle` words (A-Z lowered). Documents with one set are one class;
only one document of each class is compared.

A signature has `chunks` * `width` components of 32 bits. By pigeonhole, two signatures that differ in fewer than
chunks * (errors + 1) components differ in at most `errors` components of some chunk. Each chunk is therefore
indexed once for every way to leave `errors` of its components out, and all pairs under that distance share an
entry. With 12 chunks of 4 and one error every pair at distance 23 of 48 or less is found; of pairs with similarity
0.75 (expected distance 12), one in ten million is not (all 12 chunks would have to differ twice).

Large groups: each index entry first proposes only its smallest class to the others, and each class follows the
proposal with the nearest signature. What the full sets confirm is a forest. Entries whose members are then all in
one tree are done, however many they are; only pairs from different trees, with signatures near enough and the smallest
hashes of their sets alike, are compared after that, and of two trees the nearest pair first. Entries with more than `block` members are compared block by block in separate tasks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .components import components, settled, stored
from .text import LOWER, Words, mix, pack, slices, text_bytes, window_hashes

SHINGLE, PERCENT = 5, 75
CHUNKS, WIDTH, ERRORS = 12, 4, 1
#: Pairs whose signatures differ in more components are not confirmed: six deviations beyond the mean at 0.75.
FARTHEST = 30
#: Smallest shingle hashes a class shows its neighbours; the share of the smallest of a union that must be common: with
#: 256 of them, six deviations below 0.75. A set that is no larger is shown whole, and then the share is nearly exact.
SKETCH, SHARE, WHOLE_SHARE = 256, 0.58, 0.74
#: What tells a set from all others: its size and two sums of its hashes.
MARK = ["n_shingles", "mark1", "mark2"]
#: Members of an index entry that one task compares with each other.
BLOCK = 2048

_RANDOM = np.random.default_rng(20240301)
_MULTIPLY = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, 1024, dtype=np.uint64)


def shingles(column, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    runs = window_hashes(hashes, size)
    for first, count in zip(words.doc_starts, words.counts, strict=False):
        if count >= size:
            yield np.unique(runs[first:first + count - size + 1])
        elif count:
            yield window_hashes(hashes[first:first + count], int(count))
        else:
            yield hashes[:0]


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and two sums of their hashes: with the size they tell sets apart."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    marks = np.zeros((len(sets), 2), np.int64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        cuts = np.cumsum(sizes[some]) - sizes[some]
        marks[some, 0] = np.add.reduceat(flat, cuts).view(np.int64)
        marks[some, 1] = np.add.reduceat(mix(flat ^ _ADD[-1]), cuts).view(np.int64)
    return sizes, marks


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, length: int, sketch: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            sets = list(shingles(batch.column("_text"), shingle))
            sizes, marks = _marks(sets)
            some = np.flatnonzero(sizes)
            signature = np.zeros((len(sets), length), np.uint32)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                cuts = np.cumsum(sizes[some]) - sizes[some]
                scratch = np.empty_like(flat)
                for k in range(length):
                    np.multiply(flat, _MULTIPLY[k], out=scratch)
                    scratch += _ADD[k]
                    signature[some, k] = (np.minimum.reduceat(scratch, cuts) >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                 pa.array([pack(s) if n else None for s, n in zip(signature, sizes, strict=True)], pa.binary()),
                 pa.array([pack((s[:sketch] >> np.uint64(32)).astype(np.uint32)) for s in sets], pa.binary())],
                ["id", "n_shingles", "mark1", "mark2", "signature", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            sets = list(shingles(batch.column("_text"), shingle))
            sizes, marks = _marks(sets)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                                              pa.array([pack(x) for x in sets], pa.binary())], [*MARK, "set"])


def _marked(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The rows with the marks of their sets."""
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 20):
            sizes, marks = _marks(list(shingles(batch.column("_text"), shingle)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1])],
                                             [*batch.schema.names, *MARK])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common > 0 and 100 * common >= percent * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def alike(x: np.ndarray, y: np.ndarray, size: int) -> bool:
    """Whether two sets may be similar enough, judged by the smallest hashes of their union."""
    both = np.concatenate([x, y])
    both.sort()
    same = both[1:] == both[:-1]
    if len(x) < size and len(y) < size:
        return int(same.sum()) >= WHOLE_SHARE * (len(both) - int(same.sum()))
    # Up to the smaller of the two last hashes the union is known.
    last = min(x[-1] if len(x) >= size else both[-1], y[-1] if len(y) >= size else both[-1])
    known = int(np.searchsorted(both, last, side="right"))
    common = int(same[:max(0, known - 1)].sum())
    return common >= SHARE * (known - common)


def _close_pairs(table: pa.Table, width: int, errors: int, farthest: int, percent: int, sketch: int) -> pa.Table:
    """Pairs of different trees inside one index entry (or two blocks of one) with near signatures and sizes.

    A pair that shares several entries is looked at in the first one only."""
    table = table.sort_by("class")
    ids, trees, sizes = (np.asarray(table[c].combine_chunks()) for c in ("class", "tree", "n_shingles"))
    side, square, place = np.asarray(table["side"].combine_chunks()), bool(table["square"][0].as_py()), table["place"][0].as_py()
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(len(ids), -1)
    sketches = [np.frombuffer(b, np.uint32) for b in table["sketch"].to_pylist()]
    choices = [list(k) for k in itertools.combinations(range(width), width - errors)]
    chunk, choice = divmod(place, len(choices))
    left = np.flatnonzero(side == 0)
    right = left if square else np.flatnonzero(side == 1)
    out = [np.zeros((5, 0), np.int64)]
    for i in left:
        others = right[right > i] if square else right
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(trees[others] != trees[i]) & (100 * small >= percent * large)]
        if not len(others):
            continue
        same = (signature[others] == signature[i]).reshape(len(others), -1, width)
        met = (same[:, :chunk].sum(axis=2) >= width - errors).any(axis=1)
        for k in choices[:choice]:
            met |= same[:, chunk][:, k].all(axis=1)
        distance = (~same).sum(axis=(1, 2))
        near = (distance <= farthest) & ~met
        near[near] = [alike(sketches[i], sketches[j], sketch) for j in others[near]]
        others, distance = others[near], distance[near]
        own = np.full(len(others), i)
        low, high = (np.where(ids[others] < ids[i], p, q) for p, q in ((others, own), (own, others)))
        out.append(np.stack([ids[low], ids[high], trees[low], trees[high], distance]))
    found = np.concatenate(out, axis=1)
    return pa.table(dict(zip(("a", "b", "tree_a", "tree_b", "distance"), map(pa.array, found), strict=True)))


def _entries(width: int, chunks: int, errors: int):
    """One hash per chunk and choice of components to leave out."""
    out = []
    for c in range(chunks):
        for n, kept in enumerate(itertools.combinations(range(width), width - errors)):
            parts = [F.substring("signature", 4 * (c * width + k) + 1, 4) for k in kept]
            out.append(F.xxhash64(F.lit(c), F.lit(n), *parts))
    return F.array(*out)


def _apart(x, y, length: int):
    """In how many components two signatures differ."""
    def differ(n, i):
        return n + (F.substr(x, 4 * i + 1, F.lit(4)) != F.substr(y, 4 * i + 1, F.lit(4))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0), differ)


def _judged(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, chunks: int, width: int, errors: int,
            farthest: int, sketch: int, block: int) -> DataFrame:
    """One row per row of `docs`: id, the mark of its set, class_id, component_id, stays (whether the row is one of the
    component's first document) and kept (of rows that stay and have no id: the first)."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    signed = stored(source.mapInArrow(functools.partial(_signatures, shingle=shingle, length=chunks * width, sketch=sketch),
                                      "id bigint, n_shingles bigint, mark1 bigint, mark2 bigint, signature binary, sketch binary")
                    .withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A class is a set, whatever the ids of its rows; its number is given when the table is written.
    classes = stored(signed.where("n_shingles > 0").groupBy(*MARK)
                     .agg(F.min("id").alias("low"), F.min(F.when(F.col("id").isNull(), F.col("row"))).alias("nameless"),
                          F.min("signature").alias("signature"), F.min("sketch").alias("sketch"))
                     .sortWithinPartitions("mark1", "mark2", "n_shingles").withColumn("class", F.monotonically_increasing_id()), "classes")

    # Index entries with more than one class, and for each class the nearest of their smallest classes.
    index = classes.select("class", F.posexplode(_entries(width, chunks, errors)).alias("place", "entry"))
    shared = (index.groupBy("entry").agg(F.min("class").alias("pivot"), F.max("class").alias("last"))
              .where("pivot <> last").select("entry", "pivot"))
    members = stored(index.join(shared, "entry").select("entry", "place", "class", "pivot"), "entries")
    signature = classes.select("class", "n_shingles", "signature")
    pivot = signature.toDF("pivot", "pivot_shingles", "pivot_signature")
    proposed = (members.where("class <> pivot").select("class", "pivot").distinct()
                .join(signature, "class").join(pivot, "pivot")
                .where(F.least("n_shingles", "pivot_shingles") * 100 >= F.greatest("n_shingles", "pivot_shingles") * percent)
                .select("class", "pivot", _apart(F.col("signature"), F.col("pivot_signature"), chunks * width).alias("distance"))
                .where(F.col("distance") <= farthest)
                .groupBy("class").agg(F.min(F.struct("distance", "pivot")).alias("best"))
                .select(F.col("best.pivot").alias("a"), F.col("class").alias("b")))
    involved = members.select("class").distinct()
    wanted = classes.join(involved, "class").select("class", "low", *MARK)
    # The texts of the smallest ids; other rows of these ids, and rows without one, have marks that are not wanted, or the same set.
    texts = (source.join(wanted.where("low is not null").select(F.col("low").alias("_id")).distinct(), "_id", "left_semi")
             .unionByName(source.where("_id is null")))
    sets = stored(texts.mapInArrow(functools.partial(_sets, shingle=shingle), "n_shingles bigint, mark1 bigint, mark2 bigint, set binary")
                  .where("n_shingles > 0").groupBy(*MARK).agg(F.min("set").alias("set")).join(wanted, MARK).select("class", "set"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(
            functools.partial(_confirmed, percent=percent), "a bigint, b bigint")

    linked = stored(confirmed(proposed), "linked").select(F.col("b").alias("root"), F.col("a").alias("parent"))
    roots = linked.union(classes.join(linked, F.col("class") == F.col("root"), "left_anti").select("class", "class"))
    trees = settled(roots).toDF("class", "tree")

    # What different trees of one entry still have to say to each other; of entries with the same members, the first speaks.
    member = members.join(trees, "class").select("entry", "place", "class", "tree")
    mixed = (member.groupBy("entry").agg(F.min("tree").alias("low"), F.max("tree").alias("high"), F.count("*").alias("size"),
                                         F.min("place").alias("place"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"))
             .where("low <> high").groupBy("size", "who", "low", "high").agg(F.min(F.struct("place", "entry"))["entry"].alias("entry"))
             .select("entry", "size"))
    open_ = member.join(mixed, "entry").join(classes.select("class", "n_shingles", "signature", "sketch"), "class")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    tasks = (open_.withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("entry", "place", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("square"),
                     "class", "tree", "n_shingles", "signature", "sketch"))
    close = stored(tasks.groupBy("entry", "i", "j").applyInArrow(
        frames.on_group(_close_pairs, width=width, errors=errors, farthest=farthest, percent=percent, sketch=sketch),
        "a bigint, b bigint, tree_a bigint, tree_b bigint, distance bigint").distinct(), "close")

    # The nearest pair of each two trees first; then all pairs whose trees are still apart.
    best = close.groupBy("tree_a", "tree_b").agg(F.min(F.struct("distance", "a", "b")).alias("best")).select("best.a", "best.b")
    first = stored(confirmed(best).join(close, ["a", "b"]).select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b")), "bridges")
    groups = components(first).toDF("tree", "component")
    still = (close.join(groups.toDF("tree_a", "group_a"), "tree_a", "left").join(groups.toDF("tree_b", "group_b"), "tree_b", "left")
             .withColumns({"group_a": F.coalesce("group_a", "tree_a"), "group_b": F.coalesce("group_b", "tree_b")})
             .where("group_a <> group_b").join(best, ["a", "b"], "left_anti"))
    second = stored(confirmed(still).join(close, ["a", "b"]).select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b")), "bridges")
    merged = groups if second.isEmpty() else components(first.union(second)).toDF("tree", "component")
    final = trees.join(merged, "tree", "left").select("class", F.coalesce("component", "tree").alias("component"))
    placed = final.join(classes.select("class", "low", "nameless", *MARK), "class")
    # A component's first document: the smallest id, and of several sets with that id the one with the smallest mark.
    place = F.struct(F.col("low").isNull().alias("none"), "low", "mark1", "mark2", "n_shingles", "class")
    firsts = placed.groupBy("component").agg(F.min(place).alias("first")).select(
        "component", F.col("first.low").alias("component_id"), F.col("first.class").alias("first_class"))
    of_mark = placed.join(firsts, "component").select(*MARK, "low", "nameless", "component_id",
                                                      (F.col("class") == F.col("first_class")).alias("first"))
    judged = signed.drop("signature", "sketch").join(of_mark, MARK, "left").select(
        "id", *MARK, F.coalesce("low", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("first", F.lit(True)).alias("first"), (F.col("nameless").isNull() | F.col("id").isNotNull()
                                                          | (F.col("row") == F.col("nameless"))).alias("once"))
    stays = F.col("first") & F.col("id").eqNullSafe(F.col("component_id"))
    return judged.select("id", *MARK, "class_id", "component_id", stays.alias("stays"), (stays & F.col("once")).alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS,
                    farthest: int = FARTHEST, sketch: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, class_id (smallest id with the same set), component_id (smallest id
    reachable by links), kept.

    Defined cases: a null or empty text has no shingles and is linked with nothing, not even with another empty one.
    With fewer words than a shingle the whole sequence is one. Rows with one id are one document each: of linked sets
    with the component's smallest id one is kept, with all rows of that id and set. Rows without an id are linked like all
    others; class and component are null if no row in them has an id, and of such a component one row is kept.
    """
    judged = _judged(docs, doc_id, text, shingle, percent, chunks, width, errors, farthest, sketch, block)
    return judged.select(F.col("id").alias(doc_id), "n_shingles", "class_id", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         percent: int = PERCENT, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS,
                         farthest: int = FARTHEST, sketch: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, all columns. Rows go by their id and set, not by the id alone."""
    judged = _judged(docs, doc_id, text, shingle, percent, chunks, width, errors, farthest, sketch, block)
    gone = stored(judged.where(~F.col("stays")).select(F.col("id").alias("_id"), *MARK).distinct(), "gone")
    source = frames.carried(docs, doc_id, text)
    result = T.StructType([*source.schema.fields, *[T.StructField(name, T.LongType()) for name in MARK]])

    def marked(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(functools.partial(_marked, shingle=shingle), result)
    known = marked(source.where("_id is not null")).join(gone, ["_id", *MARK], "left_anti").select("_id", "_text", "_rest")
    # Without an id, rows of one set are copies: any one stays. Rows without words stay each.
    row = F.struct("_id", "_text", "_rest").alias("_row")
    alone = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    nameless = (marked(source.where("_id is null")).join(gone.where("_id is null").drop("_id"), MARK, "left_anti")
                .select(*MARK, alone.alias("_alone"), row).groupBy(*MARK, "_alone").agg(F.first("_row").alias("_row")).select("_row.*"))
    kept = known.unionByName(nameless)
    back = {doc_id: F.col("_id"), text: F.col("_text")}
    return kept.select(*[back.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = node)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(node) AS component_id, min(node) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
