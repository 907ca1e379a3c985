"""BPE against the tokenizers library, on whole tables, every character and random strings."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = bpe.vocabulary_of()


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.query(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library(r.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(text)), r.doc_id


def test_every_character():
    """Each code point between letters, digits, white space and itself: the pattern's classes agree."""
    points = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    for first in range(0, len(points), 1000):
        text = " ".join(f"a{c}1{c}{c} {c}b" for c in points[first:first + 1000])
        assert OWN.encode(text).tolist() == library(text), hex(ord(points[first]))


PIECES = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", " ", "　", "'s", "'ll", "don't", "é", "́", "漢字",
          "🙂", "\x00", "\x1c", "​", "1234567", "½", "²", "aaaaaaaa", "Ġ", "!!!", "...", "ﬁ", "﻿", "word", " the"]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)))
def test_any_text(text):
    ids = library(text)
    assert OWN.encode(text).tolist() == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_words_and_stretches(monkeypatch):
    random.seed(1)
    text = "".join(random.choice("ab") for _ in range(30_000)) + " " + "z" * 20_000 + "\n" * 3_000 + "x  " * 2000
    assert OWN.encode(text).tolist() == library(text)
    monkeypatch.setattr(bpe, "STRETCH", 5)
    for _ in range(300):
        text = "".join(random.choice(PIECES) for _ in range(60))
        assert OWN.encode(text).tolist() == library(text)


def test_full_cache(monkeypatch):
    own = bpe.Vocabulary()
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    text = "one two three four one two three four"
    assert own.encode(text).tolist() == library(text) and len(own.known) == 2


def test_marks_as_text():
    text = "a <|endoftext|> b"
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert OWN.encode(text, specials=False).tolist() == plain.encode(text, add_special_tokens=False).ids != library(text)


def test_odd_rows(spark):
    rows = [(1, None, "x", 5), (2, "", None, 6), (None, "null id", "y", 7), (4, "long " * 50_000, "z", 8), (5, "same", "a", 9),
            (5, "same", "a", 9), (6, "<|endoftext|>", "m", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, N_Tokens int")
    coded = bpe.encode(docs.withColumnRenamed("N_Tokens", "n_tokens"))
    assert coded.columns == ["doc_id", "ids_", "n_tokens_", "ids", "n_tokens"]
    back = bpe.decode(coded, ids="ids_")
    assert back.columns == ["doc_id", "n_tokens_", "ids", "n_tokens", "decoded"]
    got = sorted(map(tuple, back.collect()), key=str)
    assert got == sorted([(i, len(library(t or "")), o, n, t or "") for i, t, o, n in rows], key=str)
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([72, None, 99999, 5],)], "ids array<int>")).collect()[0].decoded == ""


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_short_words_take_no_queue(monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("aeinorst é漢", k=rnd.randrange(1, 40))).encode()[:bpe.SHORT] for _ in range(300)] + [b"a" * bpe.SHORT, b"", b"x"]
    want = [OWN._merged_long(w) for w in words]
    monkeypatch.setattr(bpe, "heapq", None)
    assert [OWN.merged(w) for w in words] == want
