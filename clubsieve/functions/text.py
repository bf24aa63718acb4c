"""Text helpers: normalising, splitting, sampling and measuring whole columns of text."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """Lower case, stripped, runs of spaces made one; null becomes the empty string."""
    return F.regexp_replace(strip(F.lower(F.coalesce(c.cast("string"), F.lit("")))), " {2,}", " ")


def norm_texts(c: Column) -> Column:
    """norm_text() of each element of an array; the patterns only run on texts that they change."""
    lowered = F.transform(c, lambda s: F.lower(F.coalesce(s.cast("string"), F.lit(""))))
    return F.transform(lowered, lambda s: F.when(s.rlike(r"^\s|\s$| {2}"), norm_text(s)).otherwise(s))


def filled(c: Column) -> Column:
    """Null and the empty string count as missing."""
    return c.isNotNull() & (c.cast("string") != "")


def truthy(c: Column, dtype: str) -> Column:
    """Null, empty text, zero and false all count as missing."""
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype in ("string", "date", "timestamp"):
        return filled(c)
    if dtype.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def quoted(word: str) -> str:
    """The word as a pattern that only matches itself."""
    return re.escape(word).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\$", "[$]")


def any_of(words) -> str:
    """A pattern that finds any of the words, grouped by first letter so that most positions of a
    text are ruled out by one character."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(quoted(w[1:]))
    return "|".join(f"{quoted(c)}(?:{'|'.join(rest)})" for c, rest in by_letter.items())


def has_any(c: Column, words) -> Column:
    """Whether any of the words occurs as a substring; words that hold another one are not needed."""
    return c.rlike(any_of([w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]))


def hits(c: Column, words) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def first_label(c: Column, groups: dict[str, tuple]) -> Column:
    """Name of the first group that has a word in the text, else null."""
    return F.coalesce(*[F.when(has_any(c, words), F.lit(name)) for name, words in groups.items()])


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    tokens = F.split(c, r"(?<=\P{L})|(?=\P{L})")
    return F.array_join(F.transform(tokens, F.initcap), "")


def parse_lines(c: Column) -> Column:
    """Array of trimmed non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")


def sample_ends(c: Column, head: int, mid: int, tail: int, limit: int) -> Column:
    """Head, middle and tail of a text longer than the limit, joined by a marker line."""
    n = F.length(c)
    start = F.floor((n - mid) / 2).cast("int") + 1
    marker = F.lit("\n[...]\n")
    cut = F.concat(F.substring(c, 1, head), marker, F.substr(c, start, F.lit(mid)), marker,
                   F.right(c, F.lit(tail)))
    return F.when(n > limit, cut).otherwise(c)


def keep_top_and_bottom(c: Column, budget: int) -> Column:
    """First three quarters and last quarter of a word budget, for texts beyond it."""
    words = F.split(c, " ")
    top = int(budget * 0.75)
    bottom = budget - top
    cut = F.array_join(F.concat(F.slice(words, 1, top), F.slice(words, -bottom, bottom)), " ")
    return F.when(F.size(words) > budget, cut).otherwise(c)


def size_bytes(c: Column) -> Column:
    return F.octet_length(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")
