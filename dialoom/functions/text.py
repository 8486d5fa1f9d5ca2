"""String expressions with the text rules of dialogue files: Unicode white space and digits, many line ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever ends a line. No line can hold U+001D or U+001E, so both may serve as marks within a text of lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: The places after a line's end, where a text can be cut so that every line keeps its own.
AFTER_LINE = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
MARK, FIELD = "\x1e", "\x1d"
_WIDE, _PLAIN = "".join(map(chr, range(0xFF10, 0xFF1A))), "0123456789"


#: The same white space as characters, for trimming.
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) with c computed once: an expression that names its input several times would hold it as often."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def strip(c: Column) -> Column:
    """c without white space at its ends, U+3000 included."""
    return F.btrim(c, F.lit(_SPACES))


def blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def lines(c: Column) -> Column:
    """The lines of a text; the end of the last line opens no further one. No lines for an empty text."""
    last = lambda p: F.slice(p, 1, F.size(p) - (F.element_at(p, -1) == "").cast("int"))
    return bound(F.split(c, LINE_END, -1), last)


def plain_digits(c: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(c, _WIDE, _PLAIN)


def to_int(c: Column) -> Column:
    """An int, or null for what isn't one; never an error."""
    return plain_digits(c).try_cast("int")


def extract(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match or for an empty group."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def after(c: Column, part: str) -> Column:
    """c from the first occurrence of part on; c itself without one."""
    return bound(c, lambda t: F.substring(t, F.greatest(F.instr(t, part), F.lit(1)), F.length(t)))


def without_first(c: Column, part: Column, instead: str = "") -> Column:
    """c with the first occurrence of part replaced, literally."""


    def cut(x: Column) -> Column:
        rest = F.substring(x["t"], x["at"] + F.length(x["p"]), F.length(x["t"]))
        return F.when(x["at"] > 0, F.concat(F.substring(x["t"], F.lit(1), x["at"] - 1), F.lit(instead), rest)).otherwise(x["t"])

    placed = lambda x: F.struct(x["t"], x["p"], F.position(x["p"], x["t"]).alias("at"))
    return bound(bound(F.struct(c.alias("t"), part.alias("p")), placed), cut)
