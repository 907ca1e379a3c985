"""Batch and streaming sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Full scan of a Parquet table; with a schema given, none is read from the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def metric_samples(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, schemas.METRIC_SAMPLE)


def foreign_table(spark: SparkSession, url: str, name: str, schema: StructType | None = None,
                  predicates: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A table of another database over JDBC.

    Filters and chosen columns travel to that database; `predicates` split a large read into one query
    per task.
    """
    if schema is not None:
        options["customSchema"] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    if predicates:
        return spark.read.jdbc(url, name, predicates=list(predicates), properties=options)
    return spark.read.jdbc(url, name, properties=options)


def foreign_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Stand-in for a foreign table: a Parquet copy registered under the same name."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


# ---- streams --------------------------------------------------------------------------------------

def kafka_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Messages as (topic, batch_id, value, arrival). Without a stored offset the read starts at the first
    one. Arrival is the offset, after the partition: a sensor's messages share a partition."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topics).option("startingOffsets", "earliest").options(**options).load()
    )
    return raw.select(
        "topic", F.concat_ws("/", "topic", "partition", "offset").alias("batch_id"),
        F.col("value").cast("string").alias("value"),
        (F.col("partition").cast("bigint") * F.lit(1 << 48) + F.col("offset")).alias("arrival"),
    )


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, glob: str | None = None,
                fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Files dropped into a folder; `max_files` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def message_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """One message per file, as (batch_id, arrival, value). Files arrive in the order they were written: arrival is
    the millisecond of that, and within one a hash of the path."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("batch_id"),
        (F.unix_millis(F.col("_metadata.file_modification_time")) * 1000
         + F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1000))).alias("arrival"),
        "value",
    )


def log_file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines appended as new files of a log folder."""
    return spark.readStream.text(folder)
