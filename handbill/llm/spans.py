"""Spans of regular expressions as column expressions: positions without leaving the JVM.

A text is split by the pattern; the pieces between matches and the matches in turn give
every match's place. Places count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,value:string>>"
#: Elements that are summed up one by one; longer arrays go in pieces of so many, at most LEVELS deep.
PIECE, LEVELS = 64, 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def sums_before(numbers: Column, levels: int = LEVELS) -> Column:
    """For each of an array of ints the sum of those before it, in time that follows the array's length.

    A running sum that appends to an array copies it at each step, so long arrays are cut
    into pieces whose totals are summed first, the same way.
    """

    def one_by_one(values: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(values, first, lambda held, x: F.struct((held["at"] + x).alias("at"), F.concat(held["sums"], F.array(held["at"])).alias("sums")), lambda held: held["sums"])

    def by_pieces(values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), lambda k: F.slice(values, k * PIECE + 1, PIECE))

        def joined_up(pieces: Column) -> Column:
            totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda held, x: held + x))
            return F.flatten(F.zip_with(pieces, sums_before(totals, levels - 1), one_by_one))

        return let(cut, joined_up)

    zero = F.lit(0)
    if not levels:
        return one_by_one(numbers, zero)
    return let(numbers, lambda values: F.when(F.size(values) <= PIECE, one_by_one(values, zero)).otherwise(by_pieces(values)))


def matches(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches that are valid, as array<struct<start,end,value>>.

    gate says cheaply which texts can have any; text must not be null. The time follows the
    text's length, however many matches it has.
    """
    empty = F.array().cast(FOUND)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    parts = F.transform(F.filter(zipped, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("long"), x["value"].alias("value")))

    def placed(of: Column) -> Column:
        before = sums_before(F.transform(of, lambda x: x["gap"] + x["long"]))
        return F.zip_with(of, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("end"), x["value"].alias("value")))

    found = let(parts, placed)
    if valid is not None:
        found = F.filter(found, lambda m: valid(m["value"]))
    can = F.coalesce(gate, F.lit(False)) if gate is not None else text.rlike(pattern)
    return F.when(can, found).otherwise(empty)


#: Code points in one block of a text that is cut to be looked at in places.
BLOCK = 256


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(cut: Column, start: Column, size: Column) -> Column:
    """At most BLOCK code points of a text from start on, from its blocks."""
    k = F.floor(start / BLOCK).cast("int")
    here, following = (F.coalesce(F.get(cut, n), F.lit("")) for n in (k, k + 1))
    return F.substring(F.concat(here, following), start - k * BLOCK + 1, size)


def labelled(found: Column, kind: str, order: int) -> Column:
    """The matches as array<struct<order,kind,start,end,value>>."""
    return F.transform(found, lambda m: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(held: Column, k: Column) -> Column:
        d = F.substring(number, F.length(number) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return held + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """ISO 7064 mod 97-10 of letters A-Z (10-35) and digits, as an int."""

    def add(held: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c >= "A", (held * 100 + letter) % 97).otherwise((held * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0), add)
