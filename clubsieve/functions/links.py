"""Link scores, link types and link categories."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import first_label, has_any, hits
from .urls import base_domain, is_fetchable, path


def sport_words() -> tuple[str, ...]:
    """Words of more than two letters in the sport names."""
    return tuple(sorted({w for name in fv.SPORT_BY_NUMBER.values()
                         for w in name.lower().split() if len(w) > 2}))


def may_visit(url: Column, base: Column) -> Column:
    """Same base domain, http, no blocked host, no document, no account path."""
    domain = base_domain(url)
    return (url.rlike(r"^(https?://|/)") & (domain == base_domain(base))
            & ~has_any(domain, fv.LINK_BLOCKED_HOSTS) & is_fetchable(url, fv.DOCUMENT_ENDINGS)
            & ~F.lower(path(url)).rlike("^(" + "|".join(fv.LINK_BLOCKED_PATHS) + ")"))


def three_step_score(text: Column, url: Column, *labels: Column) -> Column:
    """100, 50 or 0 by pattern lists over URL, text and labels."""
    said = F.lower(F.concat_ws(" ", text, *labels))
    u = F.lower(url)
    match = lambda ps: u.rlike("|".join(ps)) | said.rlike("|".join(ps))
    return F.when(match(fv.LINK_HIGH_PATTERNS), 100).when(match(fv.LINK_MEDIUM_PATTERNS), 50).otherwise(0)


def navigation_score(url: Column, text: Column) -> Column:
    """Plus 100 for a structural or sport word, minus 100 for a negative one, and host penalties."""
    u = F.lower(url)
    both = F.concat(u, F.lit(" "), F.lower(text))
    score = (F.when(has_any(both, fv.NAV_STRUCTURE_WORDS + sport_words()), 100).otherwise(0)
             - F.when(has_any(both, fv.NAV_NEGATIVE_WORDS), 100).otherwise(0)
             - F.when(has_any(u, fv.NAV_SOCIAL_WORDS), 50).otherwise(0))
    return F.when(has_any(u, fv.NAV_ACCOUNT_WORDS), F.greatest(F.lit(0), score - 50)).otherwise(score)


def rubric_score(text: Column) -> Column:
    """100, 50, 25 or 0 by word tier; an excluded word always gives 0."""
    t = F.lower(text)
    out = F.when(has_any(t, fv.RUBRIC_WORDS[0]), 0)
    for points in (100, 50, 25):
        out = out.when(has_any(t, fv.RUBRIC_WORDS[points]), points)
    return out.otherwise(0)


def card_indicators(text: Column) -> Column:
    """How many words of a listing card the text has."""
    return hits(F.lower(text), fv.LISTING_CARD_WORDS)


def link_type(url: Column, text: Column) -> Column:
    return first_label(F.lower(F.concat(url, F.lit(" "), text)), fv.LINK_TYPE_WORDS)


def link_category(text: Column, kind: Column) -> Column:
    """Category of the link type if it has one, else of the first matching keyword group."""
    # One lookup, so that a type that is worked out in the same expression stands there once.
    by_type = F.create_map(*[F.lit(x) for name, types in fv.CATEGORY_OF_LINK_TYPE.items() for kind_name in types for x in (kind_name, name)])
    t = F.lower(text)
    return F.coalesce(F.try_element_at(by_type, kind), first_label(t, fv.CATEGORY_OF_LINK_TEXT),
                      F.when(has_any(t, sport_words()), "DETAIL"))
