"""Text and number column steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalake.functions.vocabulary import ALIAS_SEPARATORS

# The 29 characters that count as white space (wider than Java's \s).
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = "[" + WHITESPACE + "]"  # the same set as a regex class

UNTIDY = f" {WS}+|[{WHITESPACE.replace(' ', '')}]{WS}*"

FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def strip(col: Column) -> Column:
    """Text without surrounding white space; NULL becomes ''."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITESPACE))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    # Only runs that are not already one plain blank are rewritten, so tidy text passes through untouched.
    return F.btrim(F.regexp_replace(F.coalesce(col, F.lit("")), UNTIDY, " "), F.lit(" "))


def fold(col: Column) -> Column:
    """Case-insensitive form (lower case; differs from full case folding for a few letters such as ß)."""
    return F.lower(col)


def squash(col: Column) -> Column:
    """Collapsed and case-insensitive: the form used to compare content."""
    return fold(collapse(col))


def alias_form(col: Column) -> Column:
    """Key for alias tables: separators dropped, case ignored."""
    return fold(F.translate(col, ALIAS_SEPARATORS, ""))


def whole_number(col: Column) -> Column:
    """BIGINT of a stripped text, NULL when it is not a whole number of at most 64 bits.

    Accepts a sign, single underscores between digits and full-width digits.
    """
    digits = F.translate(col, FULL_WIDTH_DIGITS, "0123456789")
    well_formed = digits.rlike(r"\A[+-]?[0-9](_?[0-9])*\z")
    return F.when(well_formed, F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint"))


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """Literal, case-insensitive containment: '%', '_' and '\\' in the needle mean themselves."""
    return F.contains(F.lower(col), F.lower(F.lit(needle)))


def leaf_name(path: Column) -> Column:
    """Last part of a path written with either slash."""
    flat = F.btrim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), F.lit(WHITESPACE))
    return strip(F.substring_index(F.rtrim(flat, F.lit("/")), "/", -1))


def shorten_keeping_suffix(name: Column, limit: int = 255) -> Column:
    """At most ``limit`` characters; the file suffix survives when it fits."""
    # A leading dot or a trailing dot is part of the name, not a suffix.
    suffix = F.regexp_extract(name, r"(?s)\A.+?(\.[^.]+)\z", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    room = F.lit(limit) - F.length(suffix)
    return (
        F.when(F.length(name) <= limit, name)
        .when((suffix != "") & (room > 0), F.concat(F.substr(stem, F.lit(1), room), suffix))
        .otherwise(F.left(name, F.lit(limit)))
    )
