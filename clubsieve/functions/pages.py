"""Page text and page classification from raw HTML, with built-in expressions only."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import has_any, hits, strip
from .urls import path

ENTITIES = (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"),
            ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def drop_blocks(html: Column, tags: tuple[str, ...]) -> Column:
    """Remove comments and whole elements such as scripts."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for t in tags:
        out = F.regexp_replace(out, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    return out


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(html: Column, with_: str) -> Column:
    return unescape(F.regexp_replace(html, r"(?s)<[^>]*>", with_))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Visible text on one line, without script, style and noscript."""
    return collapse(strip_tags(drop_blocks(html, ("script", "style", "noscript")), " "))


def html_to_main_text(html: Column) -> Column:
    """Text without footers, very short lines, legal lines and bare navigation words."""
    text = strip_tags(drop_blocks(html, ("script", "style", "footer")), " ")
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda s: (F.length(s) >= 3) & ~s.rlike(fv.LEGAL_LINE_PATTERN)
                    & ~s.rlike(fv.NAVIGATION_LINE_PATTERN))
    return collapse(F.array_join(kept, " "))


def page_type_text(html: Column) -> Column:
    """The text that page_type looks at."""
    return F.lower(strip_tags(html, ""))


def page_type_text_of_untagged(untagged: Column) -> Column:
    """page_type_text() where the tags have been taken out already, see mining.parse_pages."""
    return F.lower(unescape(untagged))


def page_type(url: Column, text: Column) -> Column:
    """struct(page_type, confidence, reason) by URL pattern, else by keywords in the text.

    Pass the text as a column of its own, so that it is computed once for all keywords.
    """
    u = F.lower(url)
    by_url = [(u.contains(p), name, p) for name, ps in fv.PAGE_PATH_PATTERNS.items() for p in ps]

    def answer(name, confidence, reason):
        return F.struct(F.lit(name).alias("page_type"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    other = answer("other", 0.3, "No specific page type detected")
    cases = [F.when(c, answer(n, 0.85, f"URL matches {n} pattern: {p}")) for c, n, p in by_url]
    # All answers stand in a list, for each count those of the types, the first type last: the greatest place holds each
    # count once, where a comparison of all counts would count each word several times.
    names = list(fv.PAGE_TEXT_WORDS)[::-1]
    most = max(map(len, fv.PAGE_TEXT_WORDS.values()))
    answers = F.array(*[answer(name, 0.70, f"{n} {name} keywords") if n >= 3 else other for n in range(most + 1) for name in names])
    place = F.greatest(*[hits(text, fv.PAGE_TEXT_WORDS[name]) * len(names) + i for i, name in enumerate(names)])
    return F.coalesce(F.when(has_any(u, [p for _, _, p in by_url]), F.coalesce(*cases)), F.get(answers, place), other)


def category_text(html: Column) -> Column:
    """The text that page_category looks at."""
    return F.lower(collapse(strip_tags(drop_blocks(html, ("script", "style")), " ")))


def page_category(url: Column, text: Column) -> Column:
    """Category with the highest score of path pattern and keyword counts; weak ones are 'other'."""
    where = F.lower(path(url))
    scored = []
    for order, (name, pattern) in enumerate(fv.CATEGORY_PATH_PATTERNS.items()):
        found = F.lit(0)
        for w in fv.CATEGORY_WORDS[name]:
            # Most words are absent, which a plain search finds out far faster.
            found = found + F.when(text.contains(w), F.regexp_count(text, F.lit(rf"\b{w}\b"))).otherwise(0)
        score = F.when(where.rlike(pattern), 70).otherwise(0) + F.least(F.lit(30), found * 5)
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("order"),
                               F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] < 20, "other").otherwise(best["name"])


def has_team_list(html: Column) -> Column:
    """At least three distinct capitalised cell texts."""
    names = F.regexp_extract_all(html, F.lit(fv.TEAM_CELL_PATTERN), 1)
    unique = F.array_distinct(F.filter(F.transform(names, strip), lambda n: F.length(n) >= 4))
    return F.size(unique) >= 3


def prices(text: Column) -> Column:
    """Amounts in a text, as numbers."""
    found = F.regexp_extract_all(text, F.lit(fv.PRICE_PATTERN), 1)
    return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit("")).cast("double"))


def price_kind(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("team"), "team_fee").when(
        t.contains("individual") | t.contains("player"), "individual_fee").otherwise("unknown")


def team_counts(text: Column) -> Column:
    """Counts 1..50 that stand before teams, divisions, spots or openings."""
    found = F.regexp_extract_all(text, F.lit(fv.TEAM_COUNT_PATTERN), 1)
    return F.filter(F.transform(found, lambda v: v.try_cast("int")), lambda n: n.between(1, 50))


def header_groups(headers: Column) -> Column:
    """In how many of the four header groups a table has a column."""
    total = F.lit(0)
    for words in fv.TABLE_HEADER_WORDS.values():
        total = total + F.exists(headers, lambda h: has_any(F.lower(h), words)).cast("int")
    return total
