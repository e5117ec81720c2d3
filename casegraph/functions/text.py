"""Text helpers as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line: Java's \\R lacks the separators U+001C to U+001E.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: White space that a Python strip() removes; Java's \\s is ASCII only.
WHITE = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def splitlines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no line, and an empty text has none."""

    def body(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        return F.when(last == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    return let(F.split(text, LINE_END, -1), body)


def line_count(text: Column) -> Column:
    return F.size(splitlines(text)).cast("long")


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether the text holds one of the marks."""
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, lower case; empty without one (dotfiles have none)."""
    return F.regexp_extract(F.lower(basename(path)), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def last_segment(scope: Column) -> Column:
    return F.substring_index(scope, ".", -1)


def title_case(key: Column) -> Column:
    """snake_case -> Title Case."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def first_json(text: Column) -> Column:
    """The shortest ``{...}`` in a text (nested braces end it early); null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    return F.when(found != "", found)


def scrub(text: Column) -> Column:
    """Remove markers of reasoning transcripts, then strip."""
    # The markers.
    for token in ("<thought>", "</thought>", "Prosecutor:", "Defender:", "scratchpad:"):
        text = F.replace(text, F.lit(token), F.lit(""))
    return strip(text)


def python_round(x: Column, digits: int = 2) -> Column:
    """Half-even rounding of the exact binary value.

    ``round`` and ``bround`` see the shortest decimal form instead. The product with 10**digits is
    taken with its rounding error (Dekker's split), which decides what looks like a tie.
    """
    scale = float(10**digits)
    product = x * scale
    c = x * 134217729.0
    high = c - (c - x)
    error = (high * scale - product) + (x - high) * scale
    floor = F.floor(product).cast("double")
    over = (product - floor) - 0.5
    even = F.pmod(floor, F.lit(2.0)) == 0
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & ~even)))
    return F.when(x.isNull(), F.lit(None)).otherwise((floor + F.when(up, 1.0).otherwise(0.0)) / scale)
