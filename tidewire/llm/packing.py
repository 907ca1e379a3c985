"""Hierarchical multi-length packing of tokenised documents into windows of 128, 256, 512 and 1024 tokens.

A document's full windows of the longest tier are sequences of their own. What remains of it is routed to the shortest
tier that holds it. Tiers are packed from the longest down: a window starts with the tier's longest remainder, and its
gap is filled with whole remainders of the shorter tiers, the longest that fit, and then with the head of one more, cut
to fit; its tail goes back to the tier of its new length. A window that cannot be filled waits for more documents. At
the end of a task what still waits is cut into full windows, from the longest tier down, and what is less than the shortest tier into
windows of lower powers of two: no sequence is padded.

Sequences are dealt to step groups of equal numbers of tokens: `step_tokens` of one tier, so a step has one shape.

Everything happens where the documents are read: there is no shuffle. A task holds the tokens of `chunk_bytes` of text
and, of what it has read before, less than a window. The number of a sequence holds the task's number; a rerun of a task
makes the same sequences. An id's pieces are its own: rows with one id are packed as documents of their own.

Ids are those of the vocabulary byte_bpe_50k; the mark of a special token in a text is that token. The ranks file of the
same vocabulary is used, with which the same ids come several times faster (tests compare both).

Defined cases: a null or empty text is the closing id alone; a null id stays null; an empty table has no sequence.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .text import slices

TIERS = (1024, 512, 256, 128)
CLOSING = 0
STEP_TOKENS = 32 * 1024
#: Fixed value: the special token of the vocabulary, which its ranks file does not list.
SPECIALS = {"<|endoftext|>": 50256}
CHUNK_BYTES = 1 << 21

PIECES = ("_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, window bigint, step_group bigint")
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str | None = None):
    """Text to token ids; `vocabulary` is the path of a ranks file, that of the public vocabulary if None."""
    key = vocabulary or ""
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIALS)
        _ENCODERS[key] = functools.partial(coder.encode, allowed_special="all", disallowed_special=())
    return _ENCODERS[key]


class Packer:
    """Packs one task's documents; a piece is (document, start, length)."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens, self.task = tiers, step_tokens, task
        self.rest: list[tuple[int, int, int]] = []  # sorted (length, document, start), each shorter than a window
        self.made = 0
        self.steps: dict[int, tuple[int, int]] = {}  # the open step of a window length, and its tokens
        self.groups = 0
        self.out: list[tuple] = []

    def _sequence(self, pieces: list[tuple[int, int, int]], window: int) -> None:
        group, tokens = self.steps.get(window, (-1, 0))
        if group < 0 or tokens + window > self.step_tokens:
            group, tokens, self.groups = self.groups, 0, self.groups + 1
        self.steps[window] = group, tokens + window
        number, offset = (self.task << 40) + self.made, 0
        self.made += 1
        for length, document, start in pieces:
            self.out.append((document, start, length, number, offset, window, (self.task << 40) + group))
            offset += length

    def add(self, document: int, length: int) -> None:
        longest = self.tiers[0]
        for start in range(0, length - longest + 1, longest):
            self._sequence([(longest, document, start)], longest)
        if length % longest:
            bisect.insort(self.rest, (length % longest, document, length - length % longest))

    def pack(self, window: int, last: bool = False) -> None:
        """Full windows of this tier, each begun with a remainder of the tier; the last ones with any."""
        waiting = sum(r[0] for r in self.rest)
        shortest = 0 if last or window == self.tiers[-1] else window // 2
        while waiting >= window:
            i = bisect.bisect_right(self.rest, (window, 1 << 62, 0)) - 1
            if not last and (i < 0 or self.rest[i][0] <= shortest):
                return
            pieces, gap = [], window
            while gap:
                i = bisect.bisect_right(self.rest, (gap, 1 << 62, 0)) - 1  # the longest that fits
                if i < 0:  # none: the head of the shortest
                    length, document, start = self.rest.pop(0)
                    pieces.append((gap, document, start))
                    bisect.insort(self.rest, (length - gap, document, start + gap))
                    gap = 0
                else:
                    pieces.append(self.rest.pop(i))
                    gap -= pieces[-1][0]
            self._sequence(pieces, window)
            waiting -= window

    def close(self) -> None:
        for window in self.tiers:
            self.pack(window, last=True)
        while window > 1:
            window //= 2
            self.pack(window, last=True)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary, tiers, step_tokens, chunk_bytes) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    context = TaskContext.get()
    packer = Packer(context.partitionId() if context else 0, tiers, step_tokens)
    tokens: dict[int, np.ndarray] = {}  # of documents with pieces still to come, from
    first: dict[int, int] = {}  # this token on, of
    total: dict[int, int] = {}  # this many
    ids: dict[int, int | None] = {}
    rest: dict[int, object] = {}
    count = 0

    def emit(schema):
        pieces, packer.out = packer.out, []
        bodies = [tokens[d][s - first[d]:s - first[d] + n].tobytes() for d, s, n, *_ in pieces]
        columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
        out = pa.RecordBatch.from_arrays([
            pa.array([ids[d] for d in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
            pa.array(bodies, pa.binary()), pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
            pa.array([total[d] for d in columns[0]], pa.int64()), pa.array(columns[3], pa.int64()),
            pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64()),
            pa.array([rest[d] for d in columns[0]], schema.field("_rest").type)],
            names=["_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "_rest"])
        kept: dict[int, int] = {}
        for _, d, s in packer.rest:
            kept[d] = min(s, kept.get(d, s))
        for d in list(tokens):
            if d in kept:
                tokens[d], first[d] = tokens[d][kept[d] - first[d]:].copy(), kept[d]
            else:
                del tokens[d], first[d], total[d], ids[d], rest[d]
        return out

    schema = None
    for whole in batches:
        schema = whole.schema
        for batch in slices(whole, "_text", chunk_bytes):
            texts = batch.column("_text").to_pylist()
            for i, other, text in zip(batch.column("_id").to_pylist(), batch.column("_rest").to_pylist(), texts, strict=True):
                tokens[count] = np.array([*encode(text or ""), CLOSING], "<u4")
                ids[count], rest[count], first[count], total[count] = i, other, 0, len(tokens[count])
                packer.add(count, total[count])
                count += 1
            for window in tiers:
                packer.pack(window)
            yield emit(schema)
    if schema is not None:
        packer.close()
        yield emit(schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, vocabulary: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32 bits), ids_crc32, doc_tokens,
    sequence_id, offset, window (the length of the sequence, with its padding), step_group, and the other columns of `docs`."""
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are falling powers of two")
    source = frames.carried(docs, doc_id, text)
    result = T._parse_datatype_string(PIECES).add(source.schema["_rest"])
    packed = source.mapInArrow(functools.partial(_pack, vocabulary=vocabulary, tiers=tuple(tiers), step_tokens=step_tokens,
                                                 chunk_bytes=chunk_bytes), result)
    names = ["start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    return packed.select(F.col("_id").alias(doc_id), *frames.unless_taken(docs, *names), *frames.others(docs, doc_id, text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
