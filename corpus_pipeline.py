"""The corpus pipeline: documents to packed training sequences, one operator of `tidewire.llm` per stage.

Each stage works on all that the one before it kept. All but the last return the columns of `documents`, and n_chars is
the length of the text they return. No SQL can express the trained stage or the tokens: ORACLE_SQL is None.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import minhash_dedup, mixing, packing, suffix_dedup, toxicity
from tidewire.llm.components import stored


#: Bytes of the rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def _stage(f: Callable) -> Callable:
    """A stage whose rows go to the Python workers in batches of bounded bytes: the default bounds their number, and long texts
    make a batch large in the executor and once more in each worker."""
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return f(spark, docs, sf_dir)
    return stage


def _framed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and one struct of all others: no name of theirs clashes with a result's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*others or [F.lit(0).alias("none")]).alias("_others"))


def _unframed(docs: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """All columns back under their names."""
    return docs.select(*[F.col(c) if c in names else F.col("_others")[c].alias(c) for c in columns])


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars anew."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic (score 0.5 or more) go. It is trained on labels that are not held out."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_framed(docs, "doc_id", "text"), model)
    return _unframed(scored.where(F.col("score") < 0.5), docs.columns, "doc_id", "text")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.75 or more the one with the smallest id stays."""
    return _unframed(minhash_dedup.drop_near_duplicates(_framed(docs, "doc_id", "text")), docs.columns, "doc_id", "text")


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 that start earlier too are cut out. A character that is cut in two goes as a whole."""
    cut = suffix_dedup.remove_repeats(_framed(docs, "doc_id", "text"))
    plain = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.replace(F.make_valid_utf8(plain), F.lit("�"), F.lit("")))
    return _measured(_unframed(cut.withColumn("text", text), docs.columns, "doc_id", "text"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in mixed order: a document once for every pass that takes it."""
    return _measured(_unframed(mixing.mix(_framed(docs, "doc_id", "text", "source")), docs.columns, "doc_id", "text", "source"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, one row per piece."""
    return packing.pack(docs.select("doc_id", "text")).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                                              "sequence_id", "offset", "window", "step_group")


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
