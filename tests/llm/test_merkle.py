"""The Merkle manifest against a tree built in memory."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, more=0):
    i, text, lang, source, n = doc
    values = (i, source, lang, None if n is None else n + more, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """The root, and each leaf's siblings as (left, right) from the bottom up."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k:k + arity] for k in range(0, len(nodes), arity)]
    root, up = tree([h(*r) for r in runs], arity)
    return root, [[(tuple(run[:s]), tuple(run[s + 1:])), *up[k]] for k, run in enumerate(runs) for s in range(len(run))]


def brute(docs, arity=2):
    ordered = sorted(docs, key=lambda d: (d[2] is not None, (d[2] or "").encode(), d[0] is not None, d[0] or 0, leaf(d)))
    groups = [list(g) for _, g in groupby(ordered, key=lambda d: d[2])]
    trees = [tree([leaf(d) for d in g], arity) for g in groups]
    root, upper = tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), up in zip(groups, trees, upper, strict=True):
        for d, path in zip(g, paths, strict=True):
            whole = path + up
            node = leaf(d, d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0)
            for left, right in whole:
                node = h(*left, node, *right)
            out.append((d[0], leaf(d), subroot, root, h(*[s for left, right in whole for s in (*left, *right)]), node, node == root))
    return sorted(out, key=str)


def written(spark, tmp_path, docs):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*SCHEMA.replace(",", "").split()[::2]).collect()]
    assert sorted(map(tuple, merkle.query(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(docs)


def odd_documents():
    hot = [(i, f"text {i}", "en", "web", 5 + i % 3) for i in range(60)]
    copies = [(70, "same", "en", "web", 4)] * 9
    return hot + copies + [
        (None, "no id", "fr", "web", 5), (None, "no id", "fr", "web", 5), (None, None, None, None, None), (7, None, None, "a", None),
        (8, "", "", "", 0), (9, "é\x00" * 4000, "ü", "1:2", 1), (10, "x", "z", None, 1), (10, "y", "z", None, 1), (-3, "neg", "z", "w", -1),
        (22, "big", "z", "w", 2**63 - 2)]


@pytest.mark.parametrize("count", [1, 2, 79])
def test_odd_rows(spark, tmp_path, count):
    docs = odd_documents()[-count:]
    got = merkle.query(spark, written(spark, tmp_path, docs))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_empty(spark, tmp_path):
    assert merkle.query(spark, written(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize("arity", [3, 5])
def test_other_arities_and_clashing_names(spark, arity):
    docs = odd_documents()
    rows = [(*d, leaf(d), "own", 1) for d in docs]
    df = spark.createDataFrame(rows, SCHEMA + ", leaf string, root string, path int")
    out = merkle.manifest(df, "leaf", arity=arity)
    assert out.columns == [*df.columns, "subroot", "root_", "path_"]
    out = out.withColumn("proof", F.sha2(merkle.proof(F.col("path_")), 256)).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path_")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root_, r.proof) for r in out.collect()]
    assert sorted(got, key=str) == sorted([r[:5] for r in brute(docs, arity)], key=str)
    assert out.where("folded <> root_ or root <> 'own' or path <> 1").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df, "leaf", arity=1)
