"""Frames in and out of the operators: sizes, parts, and columns that are carried along."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_size(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one aggregate over one column; it only sets how many parts the work has."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def pieces(size: int, each: int) -> int:
    return max(1, -(-size // each))


def carried(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text and a struct _rest of all other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    rest: Column = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"),
                       rest.alias("_rest"))


def others(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """The carried columns back under their names."""
    return [F.col("_rest")[c].alias(c) for c in docs.columns if c not in (doc_id, text)]


def unless_taken(docs: DataFrame, *names: str) -> list[Column]:
    """Result columns; one whose name the input has already gets an underscore behind it."""
    return [F.col(c).alias(c + "_" if c in docs.columns else c) for c in names]


def on_group(f: Callable, **settings) -> Callable:
    """`f` with its settings, as a function of one group."""
    return functools.partial(_group, f=f, settings=settings)


def on_groups(f: Callable, **settings) -> Callable:
    """`f` with its settings, as a function of two cogrouped groups."""
    return functools.partial(_groups, f=f, settings=settings)


def _group(table, f, settings):
    return f(table, **settings)


def _groups(left, right, f, settings):
    return f(left, right, **settings)
