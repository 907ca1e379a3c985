"""Exact removal of repeated word passages, found by difference-cover anchors.

A window is `window` consecutive words. It goes when the same words also start earlier: in a smaller id, or
earlier in the same document. Two equal windows at any two positions have an offset below the cover's period
at which both positions lie in the cover (every difference modulo the period is a difference of two members),
so they share the hash of an anchor: the window - period + 1 words that start there. Anchors are therefore
taken at cover positions only.

1. `_anchors`: each part (documents with equal id hash) sends every distinct anchor once, to the bucket of its hash;
2. `_repeated`: a bucket tells the parts which of their anchors other parts have too;
3. `_windows`: each part extends these (and its own repeated anchors) to the windows that hold them, and sends
   each distinct window once, with the smallest id that has it;
4. `_earlier`: a bucket tells every part but the first which windows start earlier elsewhere;
5. `_cut`: each part removes the covered words.

A passage in a third of all documents is one entry per part in its bucket, never one per document. No pairs are made.

Defined cases: a null or empty text has no words. A null id counts as the smallest. Rows with one id are sections of
one document, in the order of their texts; a window never spans two of them. Other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .text import Words, by_bucket, grouped, members, mix, pack, runs, slices, text_bytes, unpack, window_hashes, within

WINDOW = 20
#: Perfect difference set: fixed mathematical values. All differences modulo 13 occur.
PERIOD, COVER = 13, (0, 1, 3, 9)

#: Bytes of text a part holds, and bytes of text whose anchors or windows a bucket holds.
PART_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20

MESSAGE = "bucket int, part int, keys binary, checks binary, ids binary"
REPLY = "part int, keys binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()),
                      ("ids", pa.binary())])
_REPLY = pa.schema([("part", pa.int32()), ("keys", pa.binary())])
NO_ID = np.iinfo(np.int64).min


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id, null first, and by text among equal ids."""
    ids = table["_id"].combine_chunks()
    filled = np.asarray(pc.fill_null(ids, NO_ID))
    order = np.argsort(filled, kind="stable")
    again = np.flatnonzero(~grouped(filled[order]))
    if len(again):
        texts = pc.fill_null(table["_text"], "").to_pylist()
        order = np.array(sorted(range(len(filled)), key=lambda i: (filled[i], texts[i])))
    return table.take(pa.array(order))


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(pc.fill_null(table["_id"].combine_chunks(), NO_ID))


def _anchor_hashes(hashes, counts, window, period, cover):
    """Hashes of the anchors and their positions (a position counts from the document's first word)."""
    size = window - period + 1
    firsts = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(within(counts, size))
    wanted = np.zeros(period, dtype=bool)
    wanted[list(cover)] = True
    at = at[wanted[(at - firsts[at]) % period]]
    return window_hashes(hashes, size)[at], at


def _hashes(table: pa.Table):
    """Word hashes of all rows and the word count of each row."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in slices(table, "_text"):
        words = Words(*text_bytes(batch.column("_text")))
        parts.append(words.hashes())
        counts.append(words.counts)
    return np.concatenate(parts), np.concatenate(counts)


def _message(buckets, part, keys, checks=None, ids=None) -> pa.Table:
    rows = [(b, part, pack(keys[s]), None if checks is None else pack(checks[s]), None if ids is None else pack(ids[s]))
            for b, s in by_bucket(keys, buckets)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _MESSAGE, strict=True)],
                    schema=_MESSAGE)


def _replies(parts: np.ndarray, keys: np.ndarray) -> pa.Table:
    """One row per part with its keys, sorted."""
    order = np.lexsort((keys, parts))
    parts, keys = parts[order], keys[order]
    found = runs(parts)
    return pa.table([pa.array([int(parts[a]) for a, _ in found], pa.int32()),
                     pa.array([pack(keys[a:b]) for a, b in found], pa.binary())], schema=_REPLY)


def _received(table: pa.Table) -> np.ndarray:
    got = unpack(table["keys"], np.uint64)
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _anchors(table: pa.Table, *, window, period, cover, buckets) -> pa.Table:
    part = table["part"][0].as_py()
    hashes, counts = _hashes(table)
    return _message(buckets, part, np.unique(_anchor_hashes(hashes, counts, window, period, cover)[0]))


def _senders(table: pa.Table, bodies: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.asarray(table["part"].combine_chunks()), [len(b) for b in bodies])


def _repeated(table: pa.Table) -> pa.Table:
    bodies = unpack(table["keys"], np.uint64)
    keys, parts = np.concatenate(bodies), _senders(table, bodies)
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order]
    same = ~grouped(keys)
    same[:-1] |= same[1:]
    return _replies(parts[same], keys[same])


def _windows(docs: pa.Table, replies: pa.Table, *, window, period, cover, buckets) -> pa.Table:
    if not docs.num_rows:
        return _MESSAGE.empty_table()
    docs = in_order(docs)
    hashes, counts = _hashes(docs)
    keys, at = _anchor_hashes(hashes, counts, window, period, cover)
    order = np.argsort(keys, kind="stable")
    twice = ~grouped(keys[order])
    twice[:-1] |= twice[1:]
    known = members(keys, _received(replies))
    known[order[twice]] = True
    # A window may repeat if one of the anchors that it must share does: those that start in its first `period` words.
    near = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.bincount(at[known], minlength=len(hashes)), out=near[1:])
    starts = np.flatnonzero(within(counts, window))
    starts = starts[near[starts + period] > near[starts]]
    found = window_hashes(hashes, window)[starts]
    found, first = np.unique(found, return_index=True)  # rows are in order: the first occurrence is the earliest
    starts = starts[first]
    checks = (window_hashes(mix(hashes), window)[starts] >> np.uint64(32)).astype(np.uint32)
    ids = np.repeat(_ids(docs), counts)[starts]
    return _message(buckets, docs["part"][0].as_py(), found, checks, ids)


def _earlier(table: pa.Table) -> pa.Table:
    bodies = unpack(table["keys"], np.uint64)
    keys, parts = np.concatenate(bodies), _senders(table, bodies)
    checks = np.concatenate(unpack(table["checks"], np.uint32))
    ids = np.concatenate(unpack(table["ids"], np.int64))
    order = np.lexsort((ids, checks, keys))
    later = np.zeros(len(keys), dtype=bool)
    later[1:] = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    return _replies(parts[order][later], keys[order][later])


def _cut(docs: pa.Table, replies: pa.Table, *, window, schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    docs = in_order(docs)
    hashes, counts = _hashes(docs)
    starts = np.flatnonzero(within(counts, window))
    found = window_hashes(hashes, window)[starts]
    gone = members(found, _received(replies))
    order = np.argsort(found, kind="stable")
    gone[order[~grouped(found[order])]] = True
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, starts[gone], 1)
    np.subtract.at(depth, starts[gone] + window, 1)
    removed = np.cumsum(depth[:-1]) > 0

    texts, gone_counts, spans, first = [], [], [], 0
    for batch in slices(docs, "_text"):
        data, offsets = text_bytes(batch.column("_text"))
        words = Words(data, offsets)
        out = removed[first:first + len(words)]
        first += len(words)
        kept = np.flatnonzero(~out)
        # A kept word is followed by one space, unless it is its text's last: the white space behind it becomes that space.
        more = np.zeros(len(kept), dtype=bool)
        more[:-1] = words.doc[kept[1:]] == words.doc[kept[:-1]]
        use = np.zeros(len(data) + 1, np.int8)
        use[words.starts[kept]] += 1
        use[words.ends[kept] + more] -= 1
        use = np.cumsum(use[:-1], dtype=np.int8).astype(bool)
        data = data.copy()
        data[words.ends[kept[more]]] = 0x20
        ends = np.concatenate([[0], np.cumsum(use)])[offsets]
        body = pa.py_buffer(pack(data[use]))
        texts.append(pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(pack(ends.astype(np.int64))), body]))
        sums = np.concatenate([[0], np.cumsum(out)])
        gone_counts.append(sums[words.doc_starts[1:]] - sums[words.doc_starts[:-1]])
        spans.extend(_spans(out, words.doc_starts))
    return pa.table([docs["_id"], pa.chunked_array(texts).cast(pa.string()), pa.array(counts, pa.int64()),
                     pa.array(np.concatenate(gone_counts), pa.int64()), pa.array(spans, schema.field("spans").type),
                     docs["_rest"]], schema=schema)


def _spans(out: np.ndarray, doc_starts: np.ndarray) -> list[list[dict]]:
    """Per text its maximal removed runs, in words."""
    spans = [[] for _ in range(len(doc_starts) - 1)]
    edge = np.zeros(len(out) + 1, dtype=bool)
    edge[doc_starts] = True
    before = np.concatenate([[False], out])[:-1]
    after = np.concatenate([out, [False]])[1:]
    starts = np.flatnonzero(out & (~before | edge[:-1]))
    stops = np.flatnonzero(out & (~after | edge[1:])) + 1
    for d, a, b in zip(np.searchsorted(doc_starts, starts, side="right") - 1, starts, stops, strict=True):
        spans[d].append({"start": int(a - doc_starts[d]), "length": int(b - a)})
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   period: int = PERIOD, cover: tuple[int, ...] = COVER, part_bytes: int = PART_BYTES,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of `docs`, the text without repeated words (the kept words joined by one space), n_words,
    n_removed and the removed spans (in words)."""
    if {(b - a) % period for a in cover for b in cover} != set(range(period)) or not 0 < period <= window:
        raise ValueError("every difference modulo the period must occur in the cover, and the period fit the window")
    size = frames.text_size(docs, text)
    parts, buckets = frames.pieces(size, part_bytes), frames.pieces(size, bucket_bytes)
    source = frames.carried(docs, doc_id, text).withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    by_part = source.groupBy("part")
    settings = {"window": window, "period": period, "cover": cover, "buckets": buckets}
    anchors = by_part.applyInArrow(frames.on_group(_anchors, **settings), MESSAGE)
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, REPLY)
    windows = by_part.cogroup(repeated.groupBy("part")).applyInArrow(frames.on_groups(_windows, **settings), MESSAGE)
    earlier = windows.groupBy("bucket").applyInArrow(_earlier, REPLY)

    result = T._parse_datatype_string("_id bigint, _text string, n_words bigint, n_removed bigint, "
                                      "spans array<struct<start:bigint,length:bigint>>").add(source.schema["_rest"])
    cut = by_part.cogroup(earlier.groupBy("part")).applyInArrow(frames.on_groups(_cut_of, window=window), result)
    return cut.select(F.col("_id").alias(doc_id), F.col("_text").alias(text), *frames.others(docs, doc_id, text),
                      *frames.unless_taken(docs, "n_words", "n_removed", "spans"))


def _cut_of(docs, replies, window):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", spans), ("_rest", docs.schema.field("_rest").type)])
    return _cut(docs, replies, window=window, schema=schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS j FROM later, range(20) t(d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
