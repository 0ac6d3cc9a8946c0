"""Line and white-space functions with Python's definitions, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of str.splitlines() and the white space of str.split().
LINE_BREAK = r"[\n-\r\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?+"
WHITE_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

CHARS_PER_TOKEN = 4


def split_lines(text: Column) -> Column:
    """Lines of a text; no empty line after the last break, none at all for an empty text, null for null."""
    last = F.regexp_extract(F.right(text, F.lit(2)), rf"(?:{LINE_BREAK})\z", 0)  # goes first, so that the text is split once
    whole = F.left(text, F.length(text) - F.length(last))
    others = reduce(or_, (F.contains(text, F.lit(x)) for x in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"))
    return F.when(text == "", F.array().cast("array<string>")).when(others, F.split(whole, LINE_BREAK, -1)).otherwise(F.split(whole, "\n", -1))


def collapse(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITE_SPACE[1:-2]}]")  # ends at the first sign that is none


def token_estimate(text: Column) -> Column:
    """Rough size of a text in tokens, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN))).cast("long")


def first_line(text: Column) -> Column:
    return F.coalesce(F.get(split_lines(text), F.lit(0)), F.lit(""))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")
