"""Work over the arrays of a row in time linear in their lengths.

An array that a lambda looks into has to be bound by ``let``: of a column made by another projection the optimiser keeps
only the expression, and puts it into the lambda, where it is worked out again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers(n: Column) -> Column:
    """1 to n as longs; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))


def scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array what op makes of those before it, from zero on; op may take them in any grouping.

    Each step of a fold copies what it has so far, so it goes by chunks: within them, and over the chunks' totals.  The copies
    of the totals outweigh the rest from some ten million elements on.
    """

    def within(x: Column) -> Column:
        begin = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("all"))
        step = lambda a, v: F.struct(op(a["now"], v).alias("now"), F.concat(a["all"], F.array(a["now"])).alias("all"))
        return F.aggregate(x, begin, step, lambda a: a["all"])

    def by_chunks(x: Column) -> Column:
        ranges = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))

        def apart(chunks: Column) -> Column:
            before = within(F.transform(chunks, lambda c: F.aggregate(c, zero, op)))
            return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(within(c), lambda s: op(b, s))))

        return let(ranges, apart)

    return let(values, lambda x: F.when(F.size(x) <= CHUNK, within(x)).otherwise(by_chunks(x)))


def running(values: Column) -> Column:
    """For each of an array of longs the sum of those before it."""
    return scan(values, F.lit(0).cast("long"), lambda a, v: a + v)


def highest(values: Column) -> Column:
    """For each of an array of longs that aren't negative the greatest of those before it, 0 for the first."""
    return scan(values, F.lit(0).cast("long"), lambda a, v: F.greatest(a, v))


def cut_text(text: Column, ranges: Column, block: int = 1024) -> Column:
    """The pieces of a text at array<struct<start, end>> in characters, ascending; the text is gone through once."""

    def of(blocks: Column) -> Column:
        def piece(r: Column) -> Column:
            part = lambda b: F.substr(F.element_at(blocks, (b + 1).cast("int")), F.greatest(r["start"] - b * block, F.lit(0)).cast("int") + 1, (F.least(r["end"] - b * block, F.lit(block)) - F.greatest(r["start"] - b * block, F.lit(0))).cast("int"))
            return F.when(r["start"] < r["end"], F.array_join(F.transform(F.sequence(F.floor(r["start"] / block), F.floor((r["end"] - 1) / block)), part), "")).otherwise("")

        return F.transform(ranges, piece)

    return let(F.regexp_extract_all(text, F.lit(f"[\\x{{0}}-\\x{{10ffff}}]{{1,{block}}}"), F.lit(0)), of)


def grouped(sorted_items: Column, key: Callable[[Column], Column]) -> Column:
    """Neighbours of equal key, as an array of arrays."""

    def of(x: Column) -> Column:
        starts = F.filter(numbers(F.size(x)), lambda i: (i == 1) | (key(F.element_at(x, i.cast("int"))) != key(F.element_at(x, F.greatest(i - 1, F.lit(1)).cast("int")))))

        def cut(at: Column) -> Column:
            end = lambda k: F.coalesce(F.try_element_at(at, (k + 2).cast("int")), F.size(x).cast("long") + 1)
            return F.transform(at, lambda i, k: F.slice(x, i.cast("int"), (end(k) - i).cast("int")))

        return let(starts, cut)

    return let(sorted_items, of)
