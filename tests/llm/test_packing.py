import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewire.llm import packing

SCHEMA = "doc_id bigint, text string, window int, lang string"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def verify(pieces, docs, tokenizer):
    """Every id in exactly one piece, sequences gapless; returns tokens and padding."""
    sequences, own = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        own[p.doc_id].append(p)
    padding = tokens = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        tokens += at
        padding += 1024 - at if at & (at - 1) else 0
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(own[i], key=lambda p: p.start):
            body = ids[at:at + p.length].tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(ids), zlib.crc32(body), body)
            at += p.length
        assert at == len(ids)
    return tokens, padding


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs.repartition(4), chunk_bytes=100_000).collect()
    tokens, padding = verify(pieces, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert padding == 0 and tokens
    assert {p.window for p in pieces} >= set(packing.TIERS)
    assert all(w & (w - 1) == 0 for w in {p.window for p in pieces})
    steps = defaultdict(dict)
    for p in pieces:
        steps[p.step_group][p.sequence_id] = p.window
    for windows in steps.values():
        assert len(set(windows.values())) == 1 and sum(windows.values()) <= packing.STEP_TOKENS


def test_odd_rows(spark, tokenizer):
    rows = [(1, None, 1, "a"), (2, "", 2, None), (3, "<|endoftext|> x", 3, "c"), (4, "word " * 30_000, 4, "d"), (5, "\x00é\n\n ", 5, "e")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    verify(pieces, [(r[0], r[1]) for r in rows], tokenizer)
    # The clashing column is kept, the result's own has an underscore.
    assert {(p.doc_id, p.window, p.lang) for p in pieces} == {(r[0], r[2], r[3]) for r in rows}
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_of_special_tokens(tokenizer):
    random.seed(4)
    parts = ["<|endoftext|>", "<|endoftext", "<|", "|>", " ", "  ", "\n", "word", "'s", "é", "<|startoftext|>", "1"]
    encode = packing.encoder()
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(12)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_repeated_rows_are_packed_each(spark):
    pieces = packing.pack(spark.createDataFrame([(7, "a b c", 1, "x")] * 3 + [(None, "a", 1, "x")], SCHEMA)).collect()
    assert sorted((p.doc_id is None, p.length, p.doc_tokens) for p in pieces) == [(False, 4, 4)] * 3 + [(True, 2, 2)]
