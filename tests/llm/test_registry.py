"""The registered queries, their SQL, and the pipeline."""

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidewire.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {int(q[2:].split("_")[0]) for q in registry.QUERIES} == set(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        kept.append(docs.count())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert kept[0] >= kept[1] == kept[2] > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == pieces.columns
    assert sum(r.length for r in run.collect()) == sum(r.length for r in pieces.collect())


def test_stages_with_columns_named_like_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "kept", "start", "length", "window", "offset", "Step_Group", "ids", "n_bytes", "spans", "_id", "_rest", "a.b"]
    own = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    more = docs.select("*", *[(F.lit(0.9) if c == "score" else own).alias(c) for c in names])

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, docs, SF), stage(spark, more, SF)
        assert got.columns == more.columns, name
        assert rows(got.select(*docs.columns)) == rows(want), name
        for r in got.select("doc_id", *[f"`{c}`" for c in names]).collect():
            value = None if r.doc_id % 3 == 0 else f"own {r.doc_id}"
            assert tuple(r)[1:] == (0.9, *[value] * (len(names) - 1)), name
    want, got = (corpus_pipeline.pack_sequences(spark, d.coalesce(1), SF) for d in (docs, more))
    assert got.columns == want.columns and rows(got) == rows(want)
