"""Matches, lines and blocks of texts with their places, by built-in functions, in time that grows with a text's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Set around matches; a text that holds the mark itself gets the other noncharacter in its place.
MARK, OTHER = "﷐", "﷑"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often the body names it, also within its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(lengths: Column, block: int = 256) -> Column:
    """Where each of a row of neighbours begins: the sums of the lengths before it (array<long>), block by block, so that an
    array of n is not copied n times."""

    def sums(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    whole = F.transform(lengths, lambda x: x.cast("long"))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))), lambda i: sums(F.slice(xs, i * block + 1, F.lit(block))))
    bases = lambda blocks: sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    moved = lambda blocks, at: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + F.get(at, i))))
    return let(whole, lambda xs: let(cut(xs), lambda blocks: let(bases(blocks), lambda at: moved(blocks, at))))


def unmarked(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def matches(text: Column, pattern: str | Column, before: str | Column = "") -> Column:
    """All leftmost non-overlapping matches as array<struct<part, at>>: what the pattern matches after `before`, and where it
    starts. The text must not hold the mark."""
    before, pattern = (F.lit(x) if isinstance(x, str) else x for x in (before, pattern))
    both = F.concat(F.lit("("), before, F.lit(")("), pattern, F.lit(")"))
    parts = F.split(F.regexp_replace(text, both, F.lit(f"$1{MARK}$2{MARK}")), MARK, -1)

    def placed(parts: Column) -> Column:  # every second part is a match
        each = F.arrays_zip(parts.alias("part"), starts(F.transform(parts, F.length)).alias("at"))
        return F.filter(each, lambda x, i: i % 2 == 1)

    return let(parts, placed)


def lines_of(text: Column) -> Column:
    """The lines; an empty piece after the last line end is no line."""
    rows = F.split(text, "\r?\n")
    return let(rows, lambda r: F.when((F.size(r) > 1) & (F.element_at(r, -1) == ""), F.slice(r, 1, F.size(r) - 1)).otherwise(r))


#: Characters in a block, and those seen before and after it: the second is longer than any value of bounded length.
BLOCK, BEFORE, AFTER = 16384, 512, 8192


def blocks(text: Column, size: int = BLOCK, before: int = BEFORE, after: int = AFTER) -> Column:
    """The text in blocks of at most `size` characters that end with a line where they can, as array<struct<text, at, low, high,
    line, cut>>: the block with what stands before and after it, where that begins in the whole text, where the block itself
    begins and ends in its text, the number of line ends before it, and how many of its characters belong to a line that is
    in several blocks (see long_lines)."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{size - 1}}}\n|.{{1,{size}}}"), F.lit(0))
    ends = lambda own: F.transform(own, lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))))

    def placed(own: Column) -> Column:
        each = F.arrays_zip(own.alias("own"), starts(F.transform(own, F.length)).alias("at"), starts(ends(own)).alias("line"))

        def one(x: Column, i: Column) -> Column:
            left = F.when(i > 0, F.right(F.get(own, i - 1), F.lit(before))).otherwise("")
            right = F.coalesce(F.left(F.get(own, i + 1), F.lit(after)), F.lit(""))
            low, first = F.length(left), F.instr(x["own"], "\n")
            goes_on = (i > 0) & ~F.coalesce(F.get(own, i - 1), F.lit("\n")).endswith("\n")
            cut = F.when(goes_on, F.when(first > 0, first).otherwise(F.length(x["own"]))).when((first == 0) & (i < F.size(own) - 1), F.length(x["own"])).otherwise(0)
            return F.struct(F.concat(left, x["own"], right).alias("text"), (x["at"] - low).alias("at"), low.alias("low"), (low + F.length(x["own"])).alias("high"), x["line"].alias("line"), cut.alias("cut"))

        return F.transform(each, one)

    zero, none = F.lit(0), F.lit(0).cast("long")
    only = F.struct(text.alias("text"), none.alias("at"), zero.alias("low"), F.length(text).alias("high"), none.alias("line"), zero.alias("cut"))
    return F.when(F.length(text) <= size, F.array(only)).otherwise(let(pieces, placed))


def long_lines(text: Column, size: int = BLOCK, before: int = BEFORE, after: int = AFTER) -> Column:
    """The lines that blocks() cuts, whole, with what stands before and after them, as array<struct<text, at, low, high, line>>."""
    rows = F.split(text, "\n", -1)

    def placed(own: Column) -> Column:
        each = F.arrays_zip(own.alias("own"), starts(F.transform(own, lambda r: F.length(r) + 1)).alias("at"), F.sequence(F.lit(0), F.size(own) - 1).alias("line"))
        long = F.filter(each, lambda x: F.length(x["own"]) + F.when(x["line"] < F.size(own) - 1, 1).otherwise(0) > size)

        def one(x: Column) -> Column:
            left = F.when(x["line"] > 0, F.concat(F.right(F.get(own, x["line"] - 1), F.lit(before)), F.lit("\n"))).otherwise("")
            right = F.coalesce(F.concat(F.lit("\n"), F.left(F.get(own, x["line"] + 1), F.lit(after))), F.lit(""))
            low = F.length(left)
            return F.struct(F.concat(left, x["own"], right).alias("text"), (x["at"] - low).alias("at"), low.alias("low"), (low + F.length(x["own"])).alias("high"), x["line"].cast("long").alias("line"))

        return F.transform(long, one)

    return F.when(F.length(text) > size, let(rows, placed))
