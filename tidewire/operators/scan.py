"""Ordered per-key computations that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sends a key's whole history to one task. Here a key's time line is
cut into blocks of fixed width (an interval, or a number where rows are ordered by a number). Rows are ordered only inside their (key, block); what crosses a block
border is a small per-block summary. Results equal the plain window for every block width. Keys are not
NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import bucket

_BLOCK = "__block"


def _blocked(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], block: str | int):
    part = [*keys, _BLOCK]
    inside = W.partitionBy(*part).orderBy(ts, *tie)
    number = F.floor(F.col(ts) / block) if isinstance(block, int) else bucket(ts, block)
    return df.withColumn(_BLOCK, number), part, inside


def _join_carry(rows: DataFrame, carry: DataFrame, part: Sequence[str]) -> DataFrame:
    # The rows are already hash-partitioned by (keys, block) for the window, so only the per-block
    # summary moves here.
    return rows.join(carry, on=list(part), how="left")


def lag_by_block(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], block: str,
                 tie: Sequence[str] = ()) -> DataFrame:
    """Adds prev_<col>: the value in the key's previous row, however far back it lies.

    Only the first row of a block looks beyond it. The first and last rows of all blocks are a small
    frame in which the first rows find their predecessors; both branches read the same shuffled rows.
    """
    rows, _, inside = _blocked(df, keys, ts, tie, block)
    prev = [F.lag(c).over(inside).alias(f"prev_{c}") for c in cols]
    rows = rows.select(*df.columns, *prev, F.row_number().over(inside).alias("__row"),
                       F.lead(F.lit(1)).over(inside).isNull().alias("__is_last"))
    first = F.col("__row") == 1
    across = W.partitionBy(*keys).orderBy(ts, *tie)
    edges = rows.where(first | F.col("__is_last")).select(
        *df.columns, *[F.lag(c).over(across).alias(f"prev_{c}") for c in cols], "__row"
    )
    kept = [*df.columns, *[f"prev_{c}" for c in cols]]
    return rows.where(~first).select(*kept).unionByName(edges.where(first).select(*kept))


def running_sum_by_block(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], block: str,
                         tie: Sequence[str] = ()) -> DataFrame:
    """Adds run_<col>: the key's sum over all rows up to and including this one."""
    rows, part, inside = _blocked(df, keys, ts, tie, block)
    total = rows.groupBy(*part).agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    before = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carry = total.select(*part, *[F.sum(f"__{c}").over(before).alias(f"__carry_{c}") for c in cols])
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.select("*", *[F.sum(c).over(upto).alias(f"__run_{c}") for c in cols])
    out = _join_carry(out, carry, part)

    def plus(c: str) -> Column:
        run, carried = F.col(f"__run_{c}"), F.col(f"__carry_{c}")
        return F.coalesce(run + carried, run, carried).alias(f"run_{c}")

    return out.select(*df.columns, *[plus(c) for c in cols])


def carry_forward_by_block(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], block: str | int,
                           tie: Sequence[str] = ()) -> DataFrame:
    """Adds last_<col>: the key's latest non-NULL value strictly before this row."""
    rows, part, inside = _blocked(df, keys, ts, tie, block)
    rows_before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = rows.select(
        "*", *[F.last(c, ignorenulls=True).over(rows_before).alias(f"__last_{c}") for c in cols]
    )
    blocks_before = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)

    def after(c: str) -> Column:
        end = F.col("__end")
        return F.last(F.coalesce(end[c], end[f"__last_{c}"]), ignorenulls=True).over(blocks_before).alias(f"__carry_{c}")

    # The last row of a block is taken whole from what the windows gave: this branch then reads the rows that were shuffled for
    # them, and the input is computed once.
    whole = F.struct(*[c for c in out.columns if c not in part])
    ends = out.withColumn("__is_last", F.lead(F.lit(1)).over(inside).isNull()).where("__is_last")
    ends = ends.groupBy(*part).agg(F.first(whole).alias("__end"))
    carry = ends.select(*part, *[after(c) for c in cols])
    out = _join_carry(out, carry, part)
    return out.select(
        *df.columns, *[F.coalesce(f"__last_{c}", f"__carry_{c}").alias(f"last_{c}") for c in cols]
    )
