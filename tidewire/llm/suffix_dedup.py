"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A string of `length` bytes goes when it also starts earlier: in a smaller id, or earlier in the same document.

Every such string owns one anchor: the leftmost smallest hash among the `gram`-byte strings inside it. Equal
strings have equal anchors at equal offsets. Consecutive starts with one anchor make a context, some 130 bytes
long; only suffixes that start in contexts whose anchor occurs elsewhere can repeat.

1. `_anchors`: each part (documents with equal id hash) sends every distinct anchor once, to the bucket of its hash;
2. `_repeated`: a bucket tells the parts which of their anchors other parts have too, and which are hot;
3. `_contexts_of`: each part sends the contexts of these (and of its own repeated anchors), each distinct one once;
4. `_sorted`: a bucket sorts the suffixes of its contexts. Suffixes are compared by the length of their common
   extension, found by binary search over prefix polynomial hashes, so a comparison takes logarithmic time; a
   vectorised merge sort orders all suffixes of one anchor and offset. Neighbours that agree in `length` bytes are
   the same string, verified byte by byte; all but the earliest are reported to their part;
5. `_cut`: each part removes the covered bytes.

An anchor that very many parts have is hot: its contexts are cut into single strings, dealt by the hash of the
whole string. So a bucket never holds more than one entry per part and distinct context. No pairs are made.

Defined cases: a null or empty text has no bytes. A null id counts as the smallest. Rows with one id are sections of
one document, in the order of their texts; a string never spans two of them. Other columns are carried along.
Bytes may be removed inside a character: `kept` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .substring_dedup import _ids, in_order
from .text import BASE, BYTE_TABLE, SLICE, by_bucket, grouped, inverse, members, mix, pack, powers, runs, text_bytes, unpack

LENGTH, GRAM = 100, 40
#: Bytes of text a part holds, and bytes of text whose anchors or contexts a bucket holds.
PART_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: An anchor in this many parts is hot.
HOT_PARTS = 256
#: Bytes of contexts sorted at once.
SORT_BYTES = 1 << 20

U64 = np.uint64
_HIGH, _LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)

ANCHORS = "bucket int, part int, keys binary"
REPEATED = "part int, keys binary, hot binary"
CONTEXTS = "bucket int, part int, keys binary, ids binary, starts binary, deltas binary, lengths binary, body binary"
FOUND = "part int, starts binary, counts binary, hot binary"


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split() for c in text.split(","))])


def _table(rows: list[tuple], text: str) -> pa.Table:
    schema = _schema(text)
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    got = unpack(table[column], dtype)
    return np.concatenate(got) if got else np.zeros(0, dtype)


def _senders(table: pa.Table, bodies: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.asarray(table["part"].combine_chunks()), [len(b) for b in bodies])


class Contexts:
    """All contexts of some texts: first start, number of starts, anchor hash, anchor's distance from the first start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.data, self.length = data, length
        reach, n = length - gram + 1, len(data)
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= length)
        mark = np.zeros(n + 1, np.int8)
        mark[offsets[long]] += 1
        mark[offsets[long + 1] - length + 1] -= 1
        valid = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        forth, back = powers(BASE, SLICE + length), powers(inverse(BASE), SLICE + length)
        number = np.arange(SLICE + length, dtype=np.uint64)
        starts, anchors, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        last, last_valid = -1, False
        for i in range(0, n - length + 1, SLICE):
            m = min(SLICE, n - length + 1 - i)
            part = data[i:i + m + length - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_TABLE[part] * forth[:len(part)], out=sums[1:])
            grams = (sums[gram:] - sums[:-gram]) * back[:len(part) - gram + 1]
            least, w = (grams & _HIGH) | number[:len(grams)], 1
            while 2 * w <= reach:
                least = np.minimum(least[:-w], least[w:])
                w *= 2
            if w < reach:
                least = np.minimum(least[:len(least) - (reach - w)], least[reach - w:])
            at = (least & _LOW).astype(np.int64)
            ok = valid[i:i + m]
            new = ok.copy()
            new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
            new[0] = ok[0] and (not last_valid or at[0] + i != last)
            first = np.flatnonzero(new)
            starts.append(first + i)
            anchors.append(at[first] + i)
            hashes.append(grams[at[first]])
            last, last_valid = int(at[-1]) + i, bool(ok[-1])
        self.starts, anchor = np.concatenate(starts), np.concatenate(anchors)
        self.keys = mix(np.concatenate(hashes))
        self.deltas = anchor - self.starts
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        stops = offsets[self.doc + 1] - length + 1
        stops[:-1] = np.minimum(stops[:-1], self.starts[1:])
        self.counts = stops - self.starts

    def repeated(self) -> np.ndarray:
        """Contexts whose anchor occurs more than once here."""
        order = np.argsort(self.keys, kind="stable")
        same = ~grouped(self.keys[order])
        same[:-1] |= same[1:]
        out = np.zeros(len(order), dtype=bool)
        out[order] = same
        return out

    def split(self, chosen: np.ndarray, hot: np.ndarray):
        """The chosen contexts, those with hot anchors as single strings: key, start, count, distance, and which
        ones equal an earlier one here."""
        is_hot = members(self.keys[chosen], hot)
        cold, warm = chosen[~is_hot], chosen[is_hot]
        keys, starts, counts, deltas = (a[cold] for a in (self.keys, self.starts, self.counts, self.deltas))
        again = self._again(keys, starts, counts, deltas)
        if len(warm):
            # Equal contexts are equal string by string: only the first of them is cut up.
            twice = self._again(self.keys[warm], self.starts[warm], self.counts[warm], self.deltas[warm])
            whole = warm[twice]
            warm = warm[~twice]
            single = np.repeat(self.starts[warm], self.counts[warm]) + _ramps(self.counts[warm])
            own = mix(self._hashes(single, np.full(len(single), self.length)) ^ U64(BASE))
            ones, zeros = np.ones(len(single), np.int64), np.zeros(len(single), np.int64)
            more = [(own, single, ones, zeros, self._again(own, single, ones, zeros)),
                    (self.keys[whole], self.starts[whole], self.counts[whole], self.deltas[whole], np.ones(len(whole), bool))]
            for m in more:
                keys, starts, counts, deltas, again = (np.concatenate(p) for p in zip((keys, starts, counts, deltas, again), m, strict=True))
        return keys, starts, counts, deltas, again

    def _hashes(self, starts, lengths) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for a, b in _batches(lengths, SLICE):
            blob, offsets = gather(self.data, starts[a:b], lengths[a:b])
            sums = _sums(blob)
            out[a:b] = (sums[offsets[1:]] - sums[offsets[:-1]]) * powers(inverse(BASE), len(blob) + 1)[offsets[:-1]]
        return out

    def _again(self, keys, starts, counts, deltas) -> np.ndarray:
        """Which contexts equal, byte by byte, an earlier one of the given."""
        order = np.lexsort((starts, keys))
        alone = grouped(keys[order])
        alone[:-1] &= grouped(keys[order])[1:]
        order = order[~alone]
        lengths = counts[order] + self.length - 1
        sums = self._hashes(starts[order], lengths)
        inner = np.lexsort((starts[order], sums, lengths, deltas[order], keys[order]))
        order, lengths, sums = order[inner], lengths[inner], sums[inner]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (keys[order][1:] == keys[order][:-1]) & (deltas[order][1:] == deltas[order][:-1]) \
            & (lengths[1:] == lengths[:-1]) & (sums[1:] == sums[:-1])
        pairs = np.flatnonzero(same)
        same[pairs] = equal_bytes(self.data, starts[order[pairs]], starts[order[pairs - 1]], lengths[pairs])
        out = np.zeros(len(keys), dtype=bool)
        out[order] = same
        return out


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _batches(lengths: np.ndarray, most: int):
    """Ranges of consecutive items whose lengths add up to about `most`."""
    total = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _sums(blob: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(BYTE_TABLE[blob] * powers(BASE, len(blob)), out=sums[1:])
    return sums


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges, one after the other, and their offsets."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)], offsets


def equal_bytes(data, a, b, lengths) -> np.ndarray:
    """Whether two ranges hold the same bytes."""
    out = np.zeros(len(a), dtype=bool)
    for i, j in _batches(lengths, SLICE):
        left, offsets = gather(data, a[i:j], lengths[i:j])
        right, _ = gather(data, b[i:j], lengths[i:j])
        out[i:j] = np.add.reduceat(left != right, offsets[:-1]) == 0
    return out


class SuffixOrder:
    """Compares suffixes of `blob` by their first `depth` bytes."""

    def __init__(self, blob: np.ndarray, depth: int):
        self.blob, self.depth = blob, depth
        self.sums, self.back = _sums(blob), powers(inverse(BASE), len(blob) + 1)

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.depth)
        sx, sy, bx, by = self.sums[x], self.sums[y], self.back[x], self.back[y]
        for _ in range(int(self.depth).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[x + mid] - sx) * bx == (self.sums[y + mid] - sy) * by
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, x, y, whole_x, whole_y) -> np.ndarray:
        """Negative, 0 or positive; whole_* are the hashes of all `depth` bytes."""
        out = np.zeros(len(x), np.int64)
        differ = np.flatnonzero(whole_x != whole_y)
        x, y = x[differ], y[differ]
        common = np.minimum(self.common(x, y), self.depth - 1)
        out[differ] = self.blob[x + common].astype(np.int64) - self.blob[y + common]
        return out

    def sort(self, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """A stable merge sort of the suffixes inside each group; `groups` is sorted. Returns the order."""
        order = np.arange(len(at))
        whole = self.hashes(at, self.depth)
        new = grouped(groups)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        start = np.repeat(first, sizes)
        size = np.repeat(sizes, sizes)
        width = 1
        while True:
            live = np.flatnonzero(size > width)
            if not len(live):
                return order
            base, end = start[live], start[live] + size[live]
            local = live - base
            odd = (local // width) % 2 == 1
            pair = base + local // (2 * width) * (2 * width)
            other = np.where(odd, pair, pair + width)
            low = np.zeros(len(live), np.int64)
            high = np.clip(end - other, 0, width)
            mine = order[live]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                theirs = order[other[open_] + mid]
                own = mine[open_]
                sign = self.compare(at[theirs], at[own], whole[theirs], whole[own])
                before = (sign < 0) | ((sign == 0) & odd[open_])  # equal: the left run's come first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            moved = order.copy()
            moved[pair + (local % width) + low] = mine
            order = moved
            width *= 2


def _part(docs: pa.Table, length: int, gram: int):
    data, offsets = text_bytes(docs["_text"])
    return Contexts(data, offsets, length, gram), data, offsets


def _anchors(docs: pa.Table, *, length, gram, buckets) -> pa.Table:
    found = np.unique(_part(docs, length, gram)[0].keys)
    part = docs["part"][0].as_py()
    return _table([(b, part, pack(found[s])) for b, s in by_bucket(found, buckets)], ANCHORS)


def _repeated(table: pa.Table, *, hot_parts) -> pa.Table:
    bodies = unpack(table["keys"], np.uint64)
    keys, parts = np.concatenate(bodies), _senders(table, bodies)
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order]
    cuts = np.flatnonzero(grouped(keys))
    sizes = np.repeat(np.diff(np.append(cuts, len(keys))), np.diff(np.append(cuts, len(keys))))
    rows = []
    order = np.lexsort((keys, parts))
    order = order[sizes[order] > 1]
    keys, parts, sizes = keys[order], parts[order], sizes[order]
    for a, b in runs(parts):
        hot = sizes[a:b] >= hot_parts
        rows.append((int(parts[a]), pack(keys[a:b]), pack(keys[a:b][hot])))
    return _table(rows, REPEATED)


def _contexts_of(docs: pa.Table, replies: pa.Table, *, length, gram, buckets) -> pa.Table:
    if not docs.num_rows:
        return _table([], CONTEXTS)
    docs = in_order(docs)
    found, data, _ = _part(docs, length, gram)
    known, hot = np.sort(_joined(replies, "keys", np.uint64)), np.sort(_joined(replies, "hot", np.uint64))
    chosen = np.flatnonzero(found.repeated() | members(found.keys, known))
    keys, starts, counts, deltas, again = found.split(chosen, hot)
    order = np.flatnonzero(~again)
    order = order[np.argsort(keys[order], kind="stable")]
    keys, starts, counts, deltas = keys[order], starts[order], counts[order], deltas[order]
    ids = _ids(docs)[found.doc[np.searchsorted(found.starts, starts, side="right") - 1]] if len(starts) else starts
    part, rows = docs["part"][0].as_py(), []
    for b, s in by_bucket(keys, buckets):
        lengths = counts[s] + length - 1
        rows.append((b, part, pack(keys[s]), pack(ids[s]), pack(starts[s].astype(np.int64)), pack(deltas[s].astype(np.uint16)),
                     pack(lengths.astype(np.uint16)), pack(gather(data, starts[s], lengths)[0])))
    return _table(rows, CONTEXTS)


def _sorted(table: pa.Table, *, length) -> pa.Table:
    bodies = unpack(table["keys"], np.uint64)
    keys, parts = np.concatenate(bodies), _senders(table, bodies)
    ids, starts = _joined(table, "ids", np.int64), _joined(table, "starts", np.int64)
    deltas, lengths = _joined(table, "deltas", np.uint16).astype(np.int64), _joined(table, "lengths", np.uint16).astype(np.int64)
    blob = _joined(table, "body", np.uint8)
    at = np.cumsum(lengths) - lengths
    order = np.lexsort((starts, ids, keys))
    cuts = np.flatnonzero(grouped(keys[order]))
    sizes = np.add.reduceat(lengths[order], cuts)
    ends = np.append(cuts, len(order))
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in _batches(sizes, SORT_BYTES):
        rows = order[ends[a]:ends[b]]
        out += _later(rows, keys, ids, starts, deltas, lengths, parts, at, blob, length)
    part, start, count = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((start, part))
    part, start, count = part[order], start[order], count[order]
    return _table([(int(part[a]), pack(start[a:b]), pack(count[a:b]), None) for a, b in runs(part)], FOUND)


def _later(rows, keys, ids, starts, deltas, lengths, parts, at, blob, length):
    """(part, first start, number of starts) of the strings in these contexts that start earlier too."""
    body, offsets = gather(blob, at[rows], lengths[rows])
    at = offsets[:-1]
    keys, ids, starts, deltas, lengths, parts = (x[rows] for x in (keys, ids, starts, deltas, lengths, parts))
    suffixes = SuffixOrder(body, length)
    # Whole contexts that are equal: all strings of all but the earliest.
    whole = suffixes.hashes(at, lengths)
    order = np.lexsort((starts, ids, whole, lengths, deltas, keys))
    k, d, n, h = keys[order], deltas[order], lengths[order], whole[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (n[1:] == n[:-1]) & (h[1:] == h[:-1])
    pairs = np.flatnonzero(same)
    same[pairs] = equal_bytes(body, at[order[pairs]], at[order[pairs - 1]], n[pairs])
    again = order[same]
    out = [(parts[again], starts[again], lengths[again] - length + 1)]
    # The rest, where an anchor has several contexts: sort their suffixes.
    heads = np.sort(order[~same])  # by key, id and start, as the rows came
    new = grouped(keys[heads])
    sizes = np.diff(np.append(np.flatnonzero(new), len(heads)))
    heads = heads[np.repeat(sizes, sizes) > 1]
    if not len(heads):
        return out
    counts = lengths[heads] - length + 1
    owner, step = np.repeat(np.arange(len(heads)), counts), _ramps(counts)
    group = np.cumsum(grouped(keys[heads]))[owner] * (1 << 17) + (deltas[heads[owner]] - step)
    order = np.argsort(group, kind="stable")  # in a group: earliest first
    owner, step, group = owner[order], step[order], group[order]
    where = at[heads[owner]] + step
    ranked = suffixes.sort(where, group)
    group, where, owner, step = group[ranked], where[ranked], owner[ranked], step[ranked]
    full = suffixes.hashes(where, length)
    later = np.zeros(len(where), dtype=bool)
    later[1:] = (group[1:] == group[:-1]) & (full[1:] == full[:-1])
    pairs = np.flatnonzero(later)
    later[pairs] = equal_bytes(body, where[pairs], where[pairs - 1], np.full(len(pairs), length))
    owner, step = owner[later], step[later]
    order = np.lexsort((step, owner))
    owner, step = owner[order], step[order]
    if len(owner):
        run = np.ones(len(owner), dtype=bool)
        run[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(run)
        own = heads[owner[first]]
        out.append((parts[own], starts[own] + step[first], np.diff(np.append(first, len(owner)))))
    return out


def _cut(docs: pa.Table, replies: pa.Table, *, length, gram, schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    docs = in_order(docs)
    found, data, offsets = _part(docs, length, gram)
    hot = np.sort(_joined(replies, "hot", np.uint64))
    chosen = np.flatnonzero(found.repeated() | members(found.keys, hot))
    _, starts, counts, _, again = found.split(chosen, hot)
    starts = np.concatenate([starts[again], _joined(replies, "starts", np.int64)])
    counts = np.concatenate([counts[again], _joined(replies, "counts", np.int64)])
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, starts + counts + length - 1, 1)
    out = np.cumsum(depth[:-1], dtype=np.int32) > 0
    kept = np.concatenate([[0], np.cumsum(~out)])[offsets]
    body = pa.Array.from_buffers(pa.large_binary(), docs.num_rows, [None, pa.py_buffer(pack(kept.astype(np.int64))), pa.py_buffer(pack(data[~out]))])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = out.copy(), out.copy()
    first[1:] &= ~out[:-1] | edge[1:-1]
    last[:-1] &= ~out[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(first, offsets)
    doc = np.repeat(np.arange(docs.num_rows), np.diff(at))
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(first - offsets[doc], pa.int64()), pa.array(last - first, pa.int64())], ["start", "length"]))
    sizes = np.diff(offsets)
    return pa.table([docs["_id"], body.cast(pa.binary()), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(kept), pa.int64()),
                     spans, docs["_rest"]], schema=schema)


def _cut_of(docs, replies, length, gram):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", spans), ("_rest", docs.schema.field("_rest").type)])
    return _cut(docs, replies, length=length, gram=gram, schema=schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """All columns of `docs` but the text, then `kept` (binary), n_bytes, n_removed and the removed spans (in bytes)."""
    if not 0 < gram <= length < 1 << 15:
        raise ValueError("the anchor must fit into the string, and the string into 32767 bytes")
    size = frames.text_size(docs, text)
    parts, buckets = frames.pieces(size, part_bytes), frames.pieces(size, bucket_bytes)
    source = frames.carried(docs, doc_id, text).withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))
    by_part = source.groupBy("part")
    settings = {"length": length, "gram": gram}
    anchors = by_part.applyInArrow(frames.on_group(_anchors, **settings, buckets=buckets), ANCHORS)
    repeated = anchors.groupBy("bucket").applyInArrow(frames.on_group(_repeated, hot_parts=hot_parts), REPEATED)
    contexts = by_part.cogroup(repeated.groupBy("part")).applyInArrow(
        frames.on_groups(_contexts_of, **settings, buckets=buckets), CONTEXTS)
    found = contexts.groupBy("bucket").applyInArrow(frames.on_group(_sorted, length=length), FOUND)
    # Parts learn which anchors are hot too: there they look for repeats string by string.
    nothing = F.lit(None).cast("binary")
    hot = repeated.filter(F.octet_length("hot") > 0).select("part", nothing.alias("starts"), nothing.alias("counts"), "hot")
    result = T._parse_datatype_string("_id bigint, kept binary, n_bytes bigint, n_removed bigint, "
                                      "spans array<struct<start:bigint,length:bigint>>").add(source.schema["_rest"])
    cut = by_part.cogroup(found.union(hot).groupBy("part")).applyInArrow(frames.on_groups(_cut_of, **settings), result)
    return cut.select(F.col("_id").alias(doc_id), *frames.others(docs, doc_id, text),
                      *frames.unless_taken(docs, "kept", "n_bytes", "n_removed", "spans"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256"))
