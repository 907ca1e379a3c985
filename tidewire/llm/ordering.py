"""Running numbers of rows in a global order, without a window over all of them or over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored


def positions(df: DataFrame, order: Sequence[Column], keep: Sequence[Column | str] = ("*",)) -> DataFrame:
    """The columns `keep` and `_at`, the place of each row, from 0, in the order given, which must tell all rows apart.

    Rows are range-sorted and written; a row's place is its place in its partition and the rows of the partitions before.
    """
    row = F.monotonically_increasing_id().alias("_row")
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, row), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    # One row for each partition of the sort: their number follows from the cluster, not from the data.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return placed.join(before, "_part").withColumn("_at", at).drop("_part", "_row", "_before")
