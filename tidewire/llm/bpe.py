"""Byte-level BPE: texts to token ids and back, with the merge ranks and vocabulary of a given file.

Encoding. Marks of special tokens are cut out first; what lies between is split into words by the vocabulary's pattern;
a word is a doubly linked list of byte symbols. A priority queue holds every adjacent pair that has a merge, lowest
rank first, leftmost first among equals. A popped pair is merged by relinking its neighbours, which queues at most two new
pairs; an entry whose symbols have changed since is stale and skipped. So a word of n bytes takes n log n steps, however
long it is. A short word needs no queue: the lowest of its few ranks is looked for at each merge. Words that occur again in a task are looked up; a bounded number of them is kept.

Decoding. The vocabulary strings of the ids are concatenated, their characters stand for bytes, and the bytes are read as
UTF-8; bytes that are no character become U+FFFD. Ids that the vocabulary lacks are skipped.

Both run where the rows are read, without a shuffle. A text is split in stretches, cut where a word must end in any case, so
a very long text needs no more memory than its ids.

Defined cases: a null or empty text has no ids, null ids are an empty text; null and repeated document ids stay as they
are; an empty table gives no row; a result column whose name the input has gets an underscore behind it.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .text import slices

#: Words that a task keeps with their ids, and the longest of them; texts in a batch; characters split at once.
KEPT_WORDS, KEPT_LENGTH, CHUNK_BYTES, STRETCH = 1 << 17, 64, 1 << 21, 1 << 20
#: Bytes of a word up to which its pairs are looked through for each merge; and no rank.
SHORT, NO_RANK = 64, 1 << 62
#: Where a word ends whatever follows: no word of the pattern has white space behind another character.
CUT = regex.compile(r"(?<=\S)(?=\s)")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks, vocabulary strings and special tokens of a byte-level BPE file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            file = json.load(f)
        model, split, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] \
                or file["normalizer"] or any(model.get(k) for k in plain):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that depend on what is around them are not read")
        alphabet, ids = byte_alphabet(), model["vocab"]
        self.byte_ids = [ids[c] for c in alphabet]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = dict(self.merges.values())
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special_ids, key=len, reverse=True))) \
            if added else None
        to_byte = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.strings = _Strings()
        for token, i in {**ids, **self.special_ids}.items():
            known = all(c in to_byte for c in token)
            self.strings[i] = b"".join(map(to_byte.__getitem__, token)) if known else token.encode()
        self.known = _Words(self)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        return self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        get, made = self.ranks.get, self.made
        ids = [self.byte_ids[b] for b in word]
        ranks = [get(pair, NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NO_RANK:
                break
            i = ranks.index(rank)
            ids[i:i + 2] = [made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NO_RANK)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        merges = self.merges
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            merge = merges.get((ids[i], ids[i + 1]))
            if merge:
                queue.append((merge[0], i, merge[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j == n or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # stale: one of the symbols has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                merge = merges.get((new, ids[k]))
                if merge:
                    heapq.heappush(queue, (merge[0], i, merge[1]))
            h = before[i]
            if h >= 0:
                merge = merges.get((ids[h], new))
                if merge:
                    heapq.heappush(queue, (merge[0], h, merge[1]))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            yield from chain.from_iterable(map(self.known.__getitem__, self.words.findall(text, at, end)))
            at = end

    def encode(self, text: str, specials: bool = True) -> np.ndarray:
        """The ids of a text; with `specials` the marks of special tokens are those tokens, else ordinary text."""
        ids: list[int] = []
        at = 0
        if specials and self.specials:
            for mark in self.specials.finditer(text):
                ids.extend(self._plain(text[at:mark.start()]))
                ids.append(self.special_ids[mark.group()])
                at = mark.end()
        ids.extend(self._plain(text[at:] if at else text))
        return np.array(ids, np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Strings(dict):
    """The bytes of each id; none of an id that the vocabulary lacks."""

    def __missing__(self, i: int) -> bytes:
        return b""


class _Words(dict):
    """Ids of the words met so far; full, it goes on without keeping more."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> list[int]:
        ids = self.vocabulary.merged(word.encode())
        if len(word) <= KEPT_LENGTH and len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


@functools.cache
def vocabulary_of(path: str | None = None) -> Vocabulary:
    """A vocabulary, read once per worker."""
    return Vocabulary(path)


def _encode(batches: Iterator[pa.RecordBatch], path, specials) -> Iterator[pa.RecordBatch]:
    vocabulary = vocabulary_of(path)
    for whole in batches:
        for batch in slices(whole, "_text", CHUNK_BYTES):
            ids = [vocabulary.encode(text or "", specials) for text in batch.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                                              batch.column("_rest")], ["_id", "ids", "_rest"])


def _decode(batches: Iterator[pa.RecordBatch], path) -> Iterator[pa.RecordBatch]:
    vocabulary = vocabulary_of(path)
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            texts = [vocabulary.decode(i.tolist() if i is not None else []) for i in _lists(batch.column("_ids"))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("_rest")], ["decoded", "_rest"])


def _lists(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """One array for each row, null elements left out."""
    for row in column:
        yield None if row.values is None else np.asarray(row.values.drop_null())


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           specials: bool = True) -> DataFrame:
    """id, ids (array of int), n_tokens, and the other columns of `docs`. `vocabulary` is the path of a file, the public
    byte-level one if None."""
    source = frames.carried(docs, doc_id, text)
    result = T.StructType([source.schema["_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), source.schema["_rest"]])
    coded = source.mapInArrow(functools.partial(_encode, path=vocabulary, specials=specials), result)
    coded = coded.withColumn("n_tokens", F.size("ids").cast("long"))
    return coded.select(F.col("_id").alias(doc_id), *frames.unless_taken(docs, "ids", "n_tokens"), *frames.others(docs, doc_id, text))


def decode(coded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """All columns of `coded` but the ids, and `decoded`, their text."""
    others = [c for c in coded.columns if c != ids]
    rest = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")])
    source = coded.select(F.col(f"`{ids}`").cast("array<int>").alias("_ids"), rest.alias("_rest"))
    result = T.StructType([T.StructField("decoded", T.StringType()), source.schema["_rest"]])
    texts = source.mapInArrow(functools.partial(_decode, path=vocabulary), result)
    return texts.select(*[F.col("_rest")[c].alias(c) for c in others], *frames.unless_taken(coded, "decoded"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs).withColumn("ids_sha256", F.sha2(F.array_join("ids", ","), 256))
    return decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
