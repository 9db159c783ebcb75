"""Small expression helpers for operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it, and only if the whole is."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each entry of a non-empty array what ``step`` makes of all entries before it, from ``zero`` on.

    An array that grows in an ``aggregate`` is copied for every entry.  So blocks of about the
    root of the length are worked through apart and joined once: n entries cost n times the root
    of n copies instead of n squared.
    """
    last = F.size(values) - 1

    def through(block: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(block, empty, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def blocked(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / width).cast("int")), lambda b: F.slice(values, b * width + 1, width))
        return let(blocks, lambda bs: let(through(F.transform(bs, lambda b: F.aggregate(b, zero, step)), zero), lambda starts: F.flatten(F.zip_with(bs, starts, through))))

    return let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocked)
