"""Texts with one managed block: taking it out, commenting lines out, writing a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.fixed import BEGIN_MARK, COMMENTED_OUT, END_MARK

BLANKS = " \t\r\x0b\x0c"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def _shape(lines: Column, kind: Callable[[Column], Column]) -> Column:
    """One character for each line."""
    return F.array_join(F.transform(lines, kind), "")


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\r\x0b\x0c]")


def lines_without_block(text: Column) -> Column:
    """The lines of a text without those from the first opening mark to the last closing one.

    An opening line begins with its mark, and a closing line is its mark, in any case. One
    empty line takes the place of the block and of blank lines next to it. Without both
    marks in this order nothing goes. Where the block is, is looked for in the lines'
    kinds, a character for each, so that no text is searched or cut more than once.
    """
    bare = lambda x: F.upper(F.btrim(x, F.lit(BLANKS)))

    def kind(line: Column) -> Column:
        marked = F.when(F.startswith(bare(line), F.lit(BEGIN_MARK)), "b").when(bare(line) == END_MARK, "e").otherwise("x")
        return F.when(_is_blank(line), " ").when(F.contains(line, F.lit("#")), marked).otherwise("x")

    def cut(both: Column) -> Column:
        lines, shape = both["lines"], both["shape"]
        first = F.instr(shape, F.lit("b"))
        last = F.length(shape) + 1 - F.instr(F.reverse(shape), F.lit("e"))
        head = F.length(F.rtrim(F.substring(shape, F.lit(1), first - 1)))
        after = F.substring(shape, last + 1, F.length(shape))
        tail = F.length(F.ltrim(after))
        left = F.concat(
            F.slice(lines, F.lit(1), head), F.array(F.lit("")), F.slice(lines, F.size(lines) - tail + 1, tail)
        )
        return F.when((first > 0) & (last <= F.length(shape)) & (last >= first), left).otherwise(lines)

    def seen(lines: Column) -> Column:
        return let(F.struct(lines.alias("lines"), _shape(lines, kind).alias("shape")), cut)

    return let(F.split(text, "\n"), seen)


def without_block(text: Column) -> Column:
    return F.array_join(lines_without_block(text), "\n")


def commented_out(lines: Column, which: Callable[[Column], Column]) -> Column:
    """The text of some lines, those commented out that ``which`` is true of (given without leading blanks).

    Blank lines before such a line go.
    """
    bare = lambda x: F.ltrim(x, F.lit(BLANKS))

    def kind(line: Column) -> Column:
        return F.when(which(bare(line)), "h").when(_is_blank(line), " ").otherwise("x")

    def before(part: Column, i: Column, parts: Column) -> Column:
        """What is between two such lines, with a mark for each blank line at its end."""
        kept = F.rtrim(part)
        goes = F.concat(kept, F.repeat(F.lit("d"), F.length(part) - F.length(kept)))
        return F.when(i == F.size(parts) - 1, part).otherwise(goes)

    def told(shape: Column) -> Column:
        return let(F.split(shape, "h"), lambda parts: F.split(F.array_join(F.transform(parts, lambda x, i: before(x, i, parts)), "h"), ""))

    def edit(both: Column) -> Column:
        kinds = both["kinds"]
        changed = F.transform(both["lines"], lambda x, i: F.when(kinds[i] == "h", F.concat(F.lit(COMMENTED_OUT), bare(x))).otherwise(x))
        return F.array_join(F.filter(changed, lambda x, i: kinds[i] != "d"), "\n")

    def seen(own: Column) -> Column:
        return let(F.struct(own.alias("lines"), told(_shape(own, kind)).alias("kinds")), edit)

    return let(lines, seen)


def is_code(line: Column) -> Column:
    """Neither empty nor a comment."""
    return (line != "") & ~F.startswith(line, F.lit("#"))


def assigned_name(line: Column) -> Column:
    """What a line assigns to: its first word, if a blank or an equals sign follows; lower case."""
    head = F.substring_index(F.substring_index(F.translate(line, BLANKS, " " * len(BLANKS)), " ", 1), "=", 1)
    return F.when(F.length(head) < F.length(line), F.lower(head))


def block(lines: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(BEGIN_MARK)), lines, F.array(F.lit(END_MARK))), "\n")
