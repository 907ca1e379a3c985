"""Predicates and formats on strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier rule and log line format.
SERIAL_MAX_BYTES = 8
SERIAL_HAS_LETTER = r"\p{L}"
SERIAL_ALPHABET = r"\A[\p{L}\p{N}-]*\z"
LOG_LINE = 'time="%s" logger="%s" level="%s" message="%s"'


def validate_serial(col: Column) -> Column:
    """A serial has at least one letter, at most 8 bytes, and only letters, numbers and hyphens."""
    return (
        col.rlike(SERIAL_HAS_LETTER)
        & (F.octet_length(col) <= SERIAL_MAX_BYTES)
        & col.rlike(SERIAL_ALPHABET)
    )


def topic_matches(col: Column, pattern: str) -> Column:
    """Topic pattern match: ``*`` stands for exactly one word, ``#`` for zero or more words."""
    return col.rlike(topic_regex(pattern))


def topic_regex(pattern: str) -> str:
    out = ""
    for i, word in enumerate(pattern.split(".")):
        if word == "#":
            # With its own separator, so that zero words leave no stray dot.
            out += r"([^.]+(\.[^.]+)*)?" if i == 0 else r"(\.[^.]+)*"
        else:
            out += (r"\." if i else "") + ("[^.]+" if word == "*" else re.escape(word))
    return rf"\A{out}\z"


def qualified_name(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def logfmt_line(time_text: Column, logger: Column, level: Column, message: Column) -> Column:
    return F.format_string(LOG_LINE, time_text, logger, level, message)


def logfmt_field(line: Column, field: str) -> Column:
    """Value of one quoted field; an empty string when the field is missing."""
    return F.regexp_extract(line, rf'(?:^| ){field}="([^"]*)"', 1)


def logfmt_last_field(line: Column, field: str) -> Column:
    """Value of the line's last field, up to the line's last quote: quotes inside it are not escaped."""
    return F.regexp_extract(line, rf'(?s)(?:^| ){field}="(.*)"\z', 1)


#: A number as JSON writes it.
NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


def number(col: Column) -> Column:
    """A number text as a double; NULL for any other text, and for one that no double holds."""
    value = F.when(col.rlike(NUMBER), col.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def frequency_text(hz: Column) -> Column:
    """A frequency as the shortest number text: 100 instead of 100.0; with an exponent of two digits or more
    below 1e-4 and from 1e21 on."""
    size, short = F.abs(hz), hz.cast("string")
    mantissa = F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(short, F.lit("E"), F.lit(2)).cast("int")
    digits = F.abs(exponent).cast("string")
    scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"),
                          F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))

    def plain(kind: str) -> Column:
        return F.regexp_replace(hz.try_cast(kind).cast("string"), r"\.?0+$", "")

    return (F.when(size == 0, F.lit("0")).when((size < 1e-4) | (size >= 1e21), scientific)
            .when(size < 1, plain("decimal(38,21)")).otherwise(plain("decimal(38,16)")))


# Size units, and the limits at which the next unit is used.
SIZE_UNITS = ["kB", "MB", "GB", "TB", "PB"]
BYTES_LIMIT, HALVES_LIMIT = 10 * 1024, 20 * 1024 - 1


def size_pretty(size: Column) -> Column:
    """A byte count with a unit, for display; each unit holds up to about ten thousand of it."""
    halves = F.floor(size / 512)  # counted in half units, so that the printed number is rounded
    out = F.when(size < BYTES_LIMIT, F.concat(size.cast("string"), F.lit(" bytes")))
    for unit in SIZE_UNITS:
        shown = F.concat(F.floor((halves + 1) / 2).cast("string"), F.lit(f" {unit}"))
        out = out.when(halves < HALVES_LIMIT, shown) if unit != SIZE_UNITS[-1] else out.otherwise(shown)
        halves = F.floor(halves / 1024)
    return out
