"""Running values inside one array, and pieces of one text, in time that grows with their length.

An array that is built by appending to it is copied for each element. Here a running value is found inside short chunks
first, then over the chunks, and added to each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .cells import bind

CHUNK = 128
PIECE = 1024  # characters


def _append(values: Column, kind: str, op: Callable[[Column, Column], Column], exclusive: bool) -> Column:
    """Running values of a short array; exclusive: of what lies before each element, null before the first."""
    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc.last.isNull(), x).otherwise(op(acc.last, x))
        return F.struct(now.alias("last"), F.concat(acc.out, F.array(acc.last if exclusive else now)).alias("out"))

    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc.out)


def running(values: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The running value up to and including each element of an array of that kind, without nulls; `op` must be associative."""
    def chunked(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(CHUNK))
        local = F.transform(starts, lambda i: _append(F.slice(v, i + 1, F.lit(CHUNK)), kind, op, False))

        def carry(parts: Column) -> Column:
            before = _append(F.transform(parts, lambda p: F.element_at(p, -1)), kind, op, True)
            return F.flatten(F.zip_with(parts, before, lambda p, b: F.when(b.isNull(), p).otherwise(
                F.transform(p, lambda x: op(b, x)))))

        return bind(local, carry)

    # one value or none is its own running value
    return bind(values, lambda v: F.when(F.size(v) > 1, chunked(v)).otherwise(v.cast(f"array<{kind}>")))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def pieces(text: Column) -> Column:
    """A text as an array of strings of `PIECE` characters, for `cut`; one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end (0-based, end exclusive) of a text given by its pieces: only the pieces touched are read."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    at = start - i * PIECE + 1
    one = F.substring(F.get(parts, i), at, end - start)
    more = F.concat(
        F.substring(F.get(parts, i), at, F.lit(PIECE)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.substring(F.get(parts, j), F.lit(1), end - j * PIECE))
    return F.when(end <= start, "").when(i == j, one).otherwise(more)
