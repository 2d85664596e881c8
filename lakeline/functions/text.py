"""Text columns: tokens, literal extraction and lenient numbers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The spellings Python's float() accepts, once underscores between digits are
# gone. Group 1 leaves out the outer whitespace, and the sign of a signed nan, which Spark
# does not take. Only single characters repeat, so long text is no danger.
_FLOAT = (
    rf"^[{WHITESPACE}]*(?:[+-](?=[nN]))?"
    r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:[+-]?inf(?:inity)?|nan))"
    rf"[{WHITESPACE}]*$"
)
_INNER_UNDERSCORE = "(?<=[0-9])_(?=[0-9])"


def strip(text: Column) -> Column:
    """Remove every kind of whitespace from both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def ends_in_ink(text: Column) -> Column:
    """True where the text ends in a visible ASCII character, so that there is nothing to strip."""
    return F.substring(text, -1, 1).between("!", "~")


def contains_all(text: Column, needles: Iterable[str]) -> Column:
    """True where ``text`` holds every needle, anywhere and case-sensitively."""
    return reduce(lambda a, b: a & b, (text.contains(n) for n in needles))


def tokens(text: Column, sep: str) -> Column:
    """All tokens around a literal separator, empty ones included."""
    return F.split(text, re.escape(sep), -1)


def token(text: Column, sep: str, index: int) -> Column:
    """The token at ``index``, counted from the back when negative; NULL when there is none.

    A front token splits no further than it has to, so a long line costs no more
    than its first few tokens.
    """
    if index < 0:
        return F.try_element_at(tokens(text, sep), F.lit(index))
    return F.get(F.split(text, re.escape(sep), index + 2), F.lit(index))


def after_last(text: Column, marker: str) -> Column:
    """What follows the last ``marker``; the whole text when there is none."""
    return F.substring_index(text, marker, -1)


def remove(text: Column, literal: str) -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def lenient_double(text: Column) -> Column:
    """Strip, then parse a number as Python's ``float()`` would; NULL where it would fail.

    ``try_cast`` alone also takes ``1.5f``, ``2d`` and hexadecimal floats, and
    refuses ``1_000`` and ``+nan``.
    """
    joined = F.when(text.contains("_"), F.regexp_replace(text, _INNER_UNDERSCORE, ""))
    spelled = F.regexp_extract(F.coalesce(joined, text), _FLOAT, 1)
    return spelled.try_cast("double")  # empty where nothing matched, so NULL


def float_text(number: Column) -> Column:
    """A double as plain text with a decimal point, ``12345678.0`` not ``1.2345678E7``.

    Values outside ``[1e-4, 1e16)`` keep Spark's scientific notation.
    """
    shortest = number.cast("string")
    plain = F.rtrim(shortest.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(number)
    in_range = (size >= 1e-4) & (size < 1e16)
    return F.when(in_range, plain).otherwise(shortest)
