"""Text expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separators: str = " ") -> Column:
    """Split on any of ``separators`` and drop empty pieces."""
    pieces = F.split(text, "[" + re.escape(separators) + "]", -1)
    return F.filter(pieces, lambda piece: piece != "")


def words(text: Column) -> Column:
    """Whitespace-separated words of a line; a blank line gives one empty word."""
    return F.split(F.btrim(text, F.lit(" \t\r\n")), r"\s+", -1)


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


_NUMBER = r"^[^0-9-]*(-?[0-9]*[.,]?[0-9]*)"
_WHOLE = r"^[^0-9-]*(-?[0-9]*)"


def lenient_double(text: Column) -> Column:
    """First number in the text; ``.`` or ``,`` is the decimal mark, no exponent, nothing found is 0."""
    found = F.replace(F.regexp_extract(text, _NUMBER, 1), F.lit(","), F.lit("."))
    # adding zero turns a negative zero into a plain one
    return F.coalesce(found.try_cast("double"), F.lit(0.0)) + F.lit(0.0)


def lenient_int(text: Column) -> Column:
    """First whole number in the text, nothing found is 0."""
    return F.coalesce(F.regexp_extract(text, _WHOLE, 1).try_cast("int"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def is_letter(char: Column) -> Column:
    return char.rlike("^[A-Za-z]$")


def is_upper_letter(char: Column) -> Column:
    return char.rlike("^[A-Z]$")


def is_digit(char: Column) -> Column:
    return char.rlike("^[0-9]$")


def first_identifier(text: Column) -> Column:
    """From the first letter on: letters, digits and apostrophes."""
    return F.regexp_extract(text, "[A-Za-z][A-Za-z0-9']*", 0)


_PATH = r"(?s)^((?:.*/)?)([^/]*?)(?:\.([^./]*))?$"


def path_parts(path: Column) -> Column:
    """Struct of directory (with its slash), stem and extension."""
    names = ("directory", "stem", "extension")
    parts = (F.regexp_extract(path, _PATH, i + 1).alias(n) for i, n in enumerate(names))
    return F.struct(*parts)


def decimal_comma(text: Column) -> Column:
    """Number that may use a comma as decimal mark; null when it is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def clean_name(name: Column) -> Column:
    """Keep ASCII letters, digits, underscore, pipe and hyphen."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_\x7C-]", "")


def base_id(name: Column) -> Column:
    return F.replace(name, F.lit("ZINC"), F.lit(""))


def short_id(name: Column) -> Column:
    """Text between the class prefix and the next underscore; empty when there is none."""
    return F.regexp_extract(F.substring(name, 5, 2147483647), "^([^_]*)_", 1)


def fixed4(value: Column) -> Column:
    """``%.4f`` of a number in [0, 1] with C rounding.

    Java formats the shortest decimal form and rounds halves up; C rounds the exact binary value and
    halves to even. ``value * 2**62`` is a whole number, so ``value * 10000`` can be split exactly into
    whole and rest, in two 31-bit halves to stay inside a long.
    """
    mask = F.lit(2**31 - 1)
    scaled = (value * F.lit(float(2**62))).cast("bigint")
    low = scaled.bitwiseAND(mask) * 10000
    high = F.shiftright(scaled, 31) * 10000 + F.shiftright(low, 31)
    whole = F.shiftright(high, 31)
    rest = F.shiftleft(high.bitwiseAND(mask), 31) + low.bitwiseAND(mask)
    half = F.lit(2**61)
    ticks = whole + ((rest > half) | ((rest == half) & (whole % 2 == 1))).cast("bigint")
    return F.concat(
        F.floor(ticks / 10000).cast("string"),
        F.lit("."),
        F.lpad((ticks % 10000).cast("string"), 4, "0"),
    )
