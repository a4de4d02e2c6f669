"""Reading numbers out of BINARY columns with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size(b: Column) -> Column:
    return F.octet_length(b).cast("long")


def uint(b: Column, offset: Column | int, width: int = 1) -> Column:
    """The big-endian unsigned number of ``width`` bytes (7 at most) at ``offset``; NULL beyond the end. Check partial reads first.

    Each read goes by way of hexadecimal text, so neighbouring fields are read as one word and taken apart by field().
    """
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.hex(F.substring(b, (at + 1).cast("int"), F.lit(width))), 16, 10).cast("long")


def field(word: Column, width: int, offset: int, size_: int = 1) -> Column:
    """Of a word of ``width`` bytes that uint() has read at once: the ``size_`` bytes at ``offset`` within it."""
    return F.shiftright(word, 8 * (width - offset - size_)).bitwiseAND(F.lit((1 << 8 * size_) - 1))


def part(b: Column, offset: Column | int, length: Column | int) -> Column:
    """Bytes [offset, offset + length)."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, length))
    return F.substring(b, (at + 1).cast("int"), n.cast("int"))


def bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def hex_of(x: Column, digits: int) -> Column:
    """A number as upper-case hexadecimal of fixed width; with unhex() the way from numbers to bytes."""
    return F.lpad(F.hex(x.cast("long")), digits, "0")


def fence(df: DataFrame) -> DataFrame:
    """``df`` itself, behind a generator of one row.

    Filters above would otherwise be pushed through the decoding projections, with a copy of every expression that
    they mention, and of what that mentions in turn: the plan would grow with the power of the layers.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
