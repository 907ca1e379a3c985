"""Exact and near duplicate removal against brute force."""

import hashlib
import random
import re

import pytest

from tidewire.llm import minhash_dedup, substring_dedup, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string"


def corpus(seed, n=60, vocabulary=40, most=90):
    """Documents of shared and own passages, with copies, near copies, a hot passage, and odd texts."""
    r = random.Random(seed)
    words = ["w%d" % i if i % 5 else "É%d," % i for i in range(vocabulary)]
    shared = [[r.choice(words) for _ in range(r.randint(15, 50))] for _ in range(5)]
    texts = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(0, most))]
        if r.random() < 0.5:
            at = r.randint(0, len(own))
            own[at:at] = shared[0] if r.random() < 0.6 else r.choice(shared)
        if texts and r.random() < 0.3:
            own = WORD.findall(r.choice(texts) or "")
            for _ in range(r.randint(0, 2)):
                if own:
                    own[r.randrange(len(own))] = r.choice(words)
        texts.append(r.choice([" ", "\n", "  ", "\t"]).join(own))
    texts += [None, "", " \n ", "a", "a b c", "x " * 400, "x" * 700, texts[0], "a"]
    ids = r.sample(range(-5, 10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


def brute_words(docs, window=20):
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key in seen:
                gone[k:k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def brute_bytes(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            key = b[k:k + length]
            if key in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(key)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))], kept)
    return out


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 2000, "bucket_bytes": 3000}, {"period": 7, "cover": (0, 1, 3), "part_bytes": 500}])
def test_words(spark, settings):
    docs = corpus(1)
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA), **settings).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_words(docs)
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 2000, "bucket_bytes": 3000}, {"part_bytes": 700, "bucket_bytes": 5000, "hot_parts": 2}])
def test_bytes(spark, settings):
    docs = corpus(2)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA), **settings).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got} == brute_bytes(docs)


def test_a_long_run_of_one_byte(spark):
    docs = [(1, "a" * 5000), (2, "b" + "a" * 120 + "b"), (3, "a" * 99)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got} == brute_bytes(docs)


def test_a_very_long_text(spark):
    r = random.Random(3)
    long = " ".join("v%d" % r.randrange(10**6) for _ in range(200_000))
    docs = [(1, long), (2, "start " + long[1000:3000] + " end"), (3, "own words only")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA), part_bytes=1 << 19).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 2000 and got[3].n_removed == 0
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert words[1].n_removed == 0 and words[2].n_removed > 200 and words[3].n_removed == 0


@pytest.mark.parametrize("remove, size", [(substring_dedup.remove_repeats, "n_words"), (suffix_dedup.remove_repeats, "n_bytes")])
def test_null_ids_repeated_rows_and_clashing_names(spark, remove, size):
    text = " ".join("word%d" % i for i in range(40))
    rows = [(None, text, 1, "p", 0.5), (7, text, 2, None, None), (7, text, 2, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, part int, _rest string, {size} double")
    got = remove(docs)
    assert {"part", "_rest", size, size + "_"} <= set(got.columns)
    removed = sorted((r.doc_id is None, r.n_removed > 0) for r in got.collect())
    # The null id is the smallest; every other row repeats it.
    assert removed == [(False, True), (False, True), (True, False), (True, False)]
    empty = remove(docs.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def brute_groups(docs, size=5, percent=75):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("settings", [{}, {"block": 2}])
def test_near_duplicates(spark, settings):
    docs = corpus(4, n=120, vocabulary=400, most=70)
    r = random.Random(5)
    base = ["b%d" % i for i in range(200)]
    for k in range(60):  # a chain of drifting copies, and copies of one text with capitals
        base[r.randrange(200)] = "c%d" % k
        docs.append((10_000 - k, " ".join(base)))
    docs += [(20_000 + k, " ".join(base).upper()) for k in range(5)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(5), **settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(docs)


def test_families_that_share_index_entries_but_no_link(spark):
    """Half of every text is common: signatures share entries, similarity is below the threshold."""
    common = ["c%d" % i for i in range(100)]
    docs = [(i, " ".join(common + ["d%d_%d" % (i // 2, k) for k in range(60)] + (["end"] if i % 2 else []))) for i in range(40)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA), block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(docs)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f g", 1), (3, "A b c d e f g", 2), (3, "A b c d e f g", 2), (5, None, 3), (6, "", 4), (7, "one two", 5), (8, "One two", 6)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, entry int")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == [
        (3, 3, 3, 3, True), (3, 3, 3, 3, True), (5, 0, 5, 5, True), (6, 0, 6, 6, True), (7, 1, 7, 7, True), (8, 1, 7, 7, False)]
    assert [tuple(r)[1:] for r in got if r.doc_id is None] == [(3, 3, 3, False)]
    empty = minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    def words(name, n=60, change=()):
        return " ".join(f"new{i}" if i in change else f"{name}{i}" for i in range(n))
    rows = [(1, words("a"), 0), (5, words("a"), 1), (5, words("b"), 2), (5, words("c"), 3), (8, words("c", change=[2]), 4),
            (None, words("a"), 5), (None, words("b", change=[59]), 6), (None, words("d"), 7), (None, words("d"), 8),
            (None, words("d", change=[0]), 9), (9, words("e"), 10), (9, words("e", change=[59]), 11), (9, words("e"), 12),
            (None, None, 13), (None, "", 14), (9, "", 15), (1, words("f"), 16), (1, words("f"), 17), (2, words("f", change=[1]), 18)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, entry int")
    got = minhash_dedup.near_duplicates(docs)
    kept = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got.where("kept").collect())
    dropped = sorted((r.doc_id or 0, r.component_id or 0) for r in got.where("not kept").collect())
    rest = {r.entry for r in minhash_dedup.drop_near_duplicates(docs).collect()}
    assert rest - {10, 12, 11, 7, 8, 9} == {0, 2, 3, 13, 14, 15, 16, 17}
    assert len(rest & {7, 8, 9}) == 1 and rest & {10, 11, 12} in ({10, 12}, {11})
    assert len(kept) == len(rest) and len(kept) + len(dropped) == len(rows)
    assert [k for k in kept if k[0] == 5] == [(5, 56, 5), (5, 56, 5)]
    assert [d for d in dropped if d[0] in (0, 2, 8)] == [(0, 0), (0, 0), (0, 1), (0, 5), (2, 1), (8, 5)]


def test_pairs_at_the_signature_distance_share_an_entry():
    """Pigeonhole: with one error allowed in each of 12 chunks, 23 differing components cannot part two signatures."""
    r = random.Random(6)
    for _ in range(300):
        differ = set(r.sample(range(48), 23))
        assert any(sum(4 * c + k in differ for k in range(4)) <= 1 for c in range(12))


def test_hashes_of_equal_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: hashlib.sha256(v[2].encode()).hexdigest() for i, v in brute_words(rows).items()}
    got = {r.doc_id: (r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (len(v[2]), hashlib.sha256(v[3]).hexdigest()) for i, v in brute_bytes(rows).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_groups(rows)
