"""The prefix trie against one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        b = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(b, [])[:h] + ts[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
            if d:
                children[paths[c][:d - 1]].add(paths[c][:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    return sorted(((ms[0], len(node), members[node[:-1]][0] if node else None, len(ms), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in ms if len(paths[c]) == len(node)).encode()).hexdigest())
                   for node, ms in members.items()), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(seed, n, longest=9, texts=2):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 950), n):
        rows += [(c, k, r.choice(["user", "assistant"]), "t" * r.randrange(texts)) for k in range(r.randrange(1, longest))]
    r.shuffle(rows)
    return rows


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.query(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint", "string"}
    assert result(got) == brute(rows)


@pytest.mark.parametrize("seed, texts", [(1, 1), (2, 3)])
def test_branching_conversations(spark, tmp_path, seed, texts):
    rows = random_rows(seed, 250, texts=texts)
    copies = [(c, k, "user", "copy") for c in range(2000, 2100) for k in range(7)]
    assert result(prefix_trie.query(spark, written(spark, tmp_path, rows + copies))) == brute(rows + copies)


@pytest.mark.parametrize("block, width, stretch, piece", [(1, 2, 3, 4), (3, 2, 5, 1), (4, 64, 4096, 1 << 16)])
def test_small_blocks_groups_and_stretches(spark, block, width, stretch, piece):
    rows = random_rows(3, 120, texts=2) + [(5000, k, "user", "long" * (k % 3)) for k in range(60)]
    rows += [(5001, k, "user", "long" * (k % 3)) for k in range(55)] + [(c, 0, "user", "end") for c in range(6000, 6040)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, width=width, stretch=stretch, piece=piece)
    assert result(got) == brute(rows, rebuild=False)


def test_each_conversation_goes_one_turn_further(spark):
    """The chains hang on one another as a path."""
    rows = [(c, k, "user", "x") for c in range(40) for k in range(c + 1)]
    assert result(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, rebuild=False)


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, None, "", ""), (1, 0, "user", "same"), (1, 0, "user", "same"),
            (2, None, "", None), (2, 5, "a", "é\x00" * 9000), (3, -1, "a:1", "b"), (4, 7, "a", ":1b"), (103, 1, "user", "x"), (200, 1, "user", "x")]
    assert result(prefix_trie.query(spark, written(spark, tmp_path, rows))) == brute(rows)
    more = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("c", "depth", "_at", "length", "n_convs")])
    assert result(prefix_trie.trie(more)) == brute(rows, rebuild=False)


def test_no_turns(spark, tmp_path):
    """Conversations that rebuilding leaves without turns, and no conversations."""
    rows = [(c, 0, "user", "x") for c in range(101, 140)]
    assert result(prefix_trie.query(spark, written(spark, f"{tmp_path}/a", rows))) == brute(rows)
    assert result(prefix_trie.query(spark, written(spark, f"{tmp_path}/b", []))) == []
