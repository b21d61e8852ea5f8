"""Column expressions over text; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import SNIPPET_CHARS

# Inline markup patterns.
FOOTNOTE = r"<sup>\[[^\]]+\]\(#fn-[^)]+\)</sup>"
SUPERSCRIPT = r"<sup>[^<]+</sup>"
LINK = r"\[([^\]]+)\]\([^)]+\)"

# Every code point with the Unicode White_Space property.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def trimmed(text: Column) -> Column:
    """Strip Unicode white space from both ends, without a regular expression."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_inline(text: Column) -> Column:
    """Drop footnotes and superscripts, unwrap links, collapse white space."""
    bare = F.regexp_replace(text, FOOTNOTE, "")
    bare = F.regexp_replace(bare, SUPERSCRIPT, "")
    bare = F.regexp_replace(bare, LINK, "$1")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def first_heading(text: Column, fallback: Column | None = None) -> Column:
    """Text of the first line that starts with "# "; the fallback when it is blank or missing."""
    heading = trimmed(F.regexp_extract(text, r"(?dm)^# (.*)", 1))
    if fallback is None:
        return heading
    return F.when(heading == "", fallback).otherwise(heading)


def snippet(text: Column) -> Column:
    """At most 240 code points, with an ellipsis where something was cut."""
    whole = trimmed(text)
    return F.when(F.length(whole) <= SNIPPET_CHARS, whole).otherwise(
        F.concat(F.substring(whole, 1, SNIPPET_CHARS), F.lit("…"))
    )


def leading_int(text: Column) -> Column:
    """The signed integer a string starts with; null when there is none or it is too large."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def path_stem(path: Column) -> Column:
    """Base name without the .md suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")
