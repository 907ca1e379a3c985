import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tidewire.llm import text

WORD = re.compile("[^\x20\x09-\x0D]+")
texts = st.lists(st.none() | st.text(alphabet="ab é\t\n   x", max_size=40), max_size=8)


@given(texts)
def test_words(rows):
    data, offsets = text.text_bytes(pa.array(rows, pa.string()))
    words = text.Words(data, offsets)
    want = [WORD.findall(r or "") for r in rows]
    assert words.counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)] == flat
    hashes = words.hashes().tolist()
    assert len(set(zip(hashes, flat, strict=True))) == len(set(flat)) == len(set(hashes))


@given(texts, st.integers(1, 4))
def test_windows(rows, k):
    words = text.Words(*text.text_bytes(pa.array(rows, pa.string())))
    runs, ok = text.window_hashes(words.hashes(), k), text.within(words.counts, k)
    assert len(runs) == len(ok)
    want = [tuple(w[i:i + k]) for w in (WORD.findall(r or "") for r in rows) for i in range(len(w) - k + 1)]
    got = runs[ok].tolist()
    assert len(got) == len(want) and len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_sliced_columns_and_long_words():
    column = pa.array(["x", "a b", None, "c" * 200_000 + " d"], pa.string()).slice(1)
    words = text.Words(*text.text_bytes(column))
    assert words.counts.tolist() == [2, 0, 2]
    again = text.Words(*text.text_bytes(pa.array(["c" * 200_000])))
    assert words.hashes()[2] == again.hashes()[0]


def test_buckets_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    found = list(text.by_bucket(keys, 7))
    assert sum(s.stop - s.start for _, s in found) == 1000 and [b for b, _ in found] == list(range(7))
    assert list(text.by_bucket(keys[:0], 7)) == []
