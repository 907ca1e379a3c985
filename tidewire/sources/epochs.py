"""Tables a stream appends to with every micro-batch, without one partition for each of them for ever.

A partition holds the micro-batches from `since` to `upto`: a single one as it is written, which a repeated attempt
replaces; `WIDTH` of them once these are over, then `WIDTH` times as many, and so on. After n micro-batches a table has at
most some WIDTH * log(n) partitions, and each row has been rewritten log(n) times (to the base of WIDTH). The micro-batch
of a row stays in its column `epoch`.

A fold writes the wide partition before it drops those it was made of, and `read` leaves out partitions that a wider one
covers: a fold that broke off changes no result, and the next one over the same span finishes it. A table belongs to one checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import tables
from .catalog import fresh

PARTITIONS = ["since", "upto"]
SPAN = "since bigint, upto bigint"
#: Partitions that become one.
WIDTH = 64


def append(rows: DataFrame, name: str, epoch: int, width: int = WIDTH) -> None:
    """Write the rows of a micro-batch, replacing what an interrupted attempt at it has left, and fold what is over."""
    spark = configure(rows.sparkSession)
    number = F.lit(epoch).cast("bigint")
    rows = rows.withColumns({c: number for c in ("epoch", *PARTITIONS)})
    if not spark.catalog.tableExists(name):
        tables.create(rows, name, PARTITIONS)
        return
    if any(since <= epoch <= upto and since < upto for since, upto in spans(spark, name)):
        raise ValueError(f"{name} holds micro-batch {epoch} and later ones already: it belongs to another checkpoint")
    rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    fold(spark, name, epoch, width)


def spans(spark: SparkSession, name: str) -> list[tuple[int, int]]:
    """(since, upto) of all partitions, by name only; folding keeps them few."""
    listed = tables.partitions(spark, name, PARTITIONS)
    return sorted((int(r.since), int(r.upto)) for r in listed.collect())


def covered(of: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans inside a wider one: what a fold that broke off has left."""
    return [s for s in of if any(w != s and w[0] <= s[0] and s[1] <= w[1] for w in of)]


def _is(span: tuple[int, int]):
    return (F.col("since") == span[0]) & (F.col("upto") == span[1])


def _whole(spark: SparkSession, name: str) -> DataFrame:
    rows = fresh(spark, name)
    for span in covered(spans(spark, name)):
        rows = rows.where(~_is(span))
    return rows


def read(spark: SparkSession, name: str) -> DataFrame:
    """All rows, each once, with the micro-batch (`epoch`) they came in."""
    return _whole(spark, name).drop(*PARTITIONS)


def fold(spark: SparkSession, name: str, epoch: int, width: int = WIDTH) -> int:
    """In micro-batch `epoch`: the widest span that ends just before it becomes one partition. Returns how many were dropped.

    Micro-batches before the running one are committed, so none of them is repeated.
    """
    if epoch == 0 or epoch % width:
        return 0
    size = width
    while epoch % (size * width) == 0:
        size *= width
    wide = (epoch - size, epoch - 1)
    inside = [s for s in spans(spark, name) if wide[0] <= s[0] and s[1] <= wide[1]]
    narrow = [s for s in inside if s != wide]
    if wide not in inside:
        if len(narrow) < 2:
            return 0
        rows = _whole(spark, name).where((F.col("since") >= wide[0]) & (F.col("upto") <= wide[1]))
        rows = rows.withColumns({c: F.lit(at).cast("bigint") for c, at in zip(PARTITIONS, wide)})
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    return tables.drop_partitions(spark, name, spark.createDataFrame(narrow, SPAN)) if narrow else 0
