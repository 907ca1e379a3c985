"""Ratios with a stated result for the empty case, and named bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_pct(num: Column, den: Column, default: float | None) -> Column:
    """round(100·num/den, 2) in decimals, or `default` when den is not positive."""
    pct = F.round(num.cast("decimal(20,0)") * F.lit(100) / den.cast("decimal(20,0)"), 2).cast("decimal(38,2)")
    empty = F.lit(default).cast("decimal(38,2)")
    return F.when(den > 0, pct).otherwise(empty)


def null_safe_pct(num: Column, den: Column) -> Column:
    """100·num/den as double; NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


Band = tuple[str, float | None, bool]


def banded(col: Column, bands: Sequence[Band]) -> Column:
    """Name of the first band whose upper limit holds the value; NULL stays NULL.

    A band is (name, limit, inclusive); the last band has limit None and takes the rest.
    """
    expr = None
    for name, limit, inclusive in bands:
        if limit is None:
            return expr.otherwise(F.when(col.isNotNull(), F.lit(name)))
        hit = (col <= F.lit(limit)) if inclusive else (col < F.lit(limit))
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    raise ValueError("the last band must have no limit")
