"""Cleaning, parsing and text extraction.  Nulls count as empty text everywhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space with the four separators that Java leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NUMBER = r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?|(?i)(nan|inf|infinity))$"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(blank_if_null(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(c: Column) -> Column:
    """One pass of ``&amp;``, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.replace(blank_if_null(c), F.lit("&amp;"), F.lit("&")), SPACES, " "))


def is_empty(c: Column) -> Column:
    return clean_text(c) == ""


def parse_float(c: Column, default: float = 0.0) -> Column:
    """A decimal number, else the default; letters that only Spark takes for a suffix are not numbers."""
    t = clean_text(c)
    return F.coalesce(F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")), F.lit(default))


def parse_int(c: Column, default: int = 0) -> Column:
    """Through double, cut towards zero; NaN, infinities and numbers out of range give the default."""
    return F.coalesce(parse_float(c, float("nan")).try_cast("int"), F.lit(default)) if default else F.coalesce(F.nanvl(parse_float(c, 0.0), F.lit(0.0)).try_cast("int"), F.lit(0))


def parse_price(c: Column) -> Column:
    """The first run of digits with an optional fraction, else 0."""
    return F.coalesce(F.regexp_extract(clean_text(c), r"[0-9]+(\.[0-9]+)?", 0).try_cast("double"), F.lit(0.0))


def comma_items(c: Column) -> Column:
    """Trimmed items between commas, empty ones dropped."""
    return F.filter(F.transform(F.split(blank_if_null(c), ","), strip), lambda x: x != "")


def normalize_category(c: Column) -> Column:
    t = clean_text(c)
    return F.when(t == "", "Unknown").otherwise(F.array_join(comma_items(t), ", "))


def clean_cuisine(c: Column) -> Column:
    """The first item, else a general word."""
    return F.coalesce(F.get(comma_items(c), F.lit(0)), F.lit("restaurant"))


def number_input(c: Column) -> Column:
    """A form's number; empty is 0."""
    return parse_float(c, 0.0)


def place_type(c: Column) -> Column:
    """snake_case as title words; the rest of each word stays as it is."""
    words = F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2_000_000_000)))
    return F.when(blank_if_null(c) == "", "Restaurant").otherwise(F.array_join(words, " "))


def safe_id(c: Column) -> Column:
    """Without the first ``places/``, other signs as dashes, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(blank_if_null(c), r"(?s)^(.*?)places/", "$1"), "[^A-Za-z0-9_-]", "-"))


def json_list(tags: Column) -> Column:
    """A JSON list of strings with a blank after each comma."""
    quoted = F.transform(tags, lambda t: F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def after(c: Column, marker: str) -> Column:
    """What follows the first marker; null without one."""
    return F.get(F.split(blank_if_null(c), re.escape(marker), 2), F.lit(1))


def before(c: Column, marker: str) -> Column:
    """What stands before the first marker; all of it without one."""
    return F.get(F.split(blank_if_null(c), re.escape(marker), 2), F.lit(0))


def line_after(c: Column, marker: str) -> Column:
    """The line below the first marker's line, trimmed; empty without one."""
    return strip(F.get(F.split(after(c, marker), LINE_END), F.lit(1)))


def text_after(c: Column, marker: str) -> Column:
    return strip(after(c, marker))


def drop_prefixes(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Each prefix in turn, once, with the white space after it."""
    out = strip(c)
    for p in prefixes:
        out = F.when(F.startswith(out, F.lit(p)), strip(F.substring(out, len(p) + 1, 2_000_000_000))).otherwise(out)
    return out


def whole(c: Column) -> Column:
    """A number without decimals, ties to even."""
    return F.bround(c.cast("double")).cast("bigint").cast("string")


def fixed3(c: Column) -> Column:
    """A number with three decimals; the double itself is rounded, not its short decimal form, ties away from zero.

    Exact below 8192: the double is split into two parts whose products with 1000
    are exact.  Larger numbers are rounded from their short decimal form.
    """
    x = F.abs(c.cast("double"))
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    a, b = high * F.lit(1000.0), (x - high) * F.lit(1000.0)
    n = F.floor(a) + F.when(a - F.floor(a) - F.lit(0.5) >= -b, 1).otherwise(0)
    small = F.concat(F.when(c.cast("double") < 0, "-").otherwise(""), F.floor(n / F.lit(1000)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(x < 8192, small).when(x >= 8192, F.format_string("%.3f", c.cast("double")))
