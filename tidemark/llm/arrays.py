"""Array expressions in DataFrame functions, with time that stays near linear for long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once; a plain expression inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _growing(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """first, op(first, v1), op(op(first, v1), v2), ... by appending; only for short arrays."""
    return F.aggregate(values, F.array(first), lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v)))


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For an array of longs what op makes, from 0, of the elements before each one, built block by block."""
    zero = F.lit(0).cast("long")

    def made(v: Column) -> Column:
        block = lambda c: F.slice(v, c * BLOCK + 1, BLOCK)
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda c: F.aggregate(block(c), zero, op))
        inside = lambda starts: F.transform(blocks, lambda c: let(block(c), lambda b: F.slice(_growing(b, F.get(starts, c), op), 1, F.size(b))))
        return F.when(F.size(v) > 0, F.flatten(let(_growing(totals, zero, op), inside))).otherwise(F.array().cast("array<bigint>"))

    return let(values, made)


def sums_before(values: Column) -> Column:
    """For an array of longs the sum of the elements before each one."""
    return _before(values, lambda a, x: a + x)


def maxima_before(values: Column) -> Column:
    """For an array of longs that aren't negative the largest of the elements before each one, 0 for the first."""
    return _before(values, lambda a, x: F.greatest(a, x))
