"""URL functions, all built-in expressions so they stay inside one generated stage."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import any_of


def canonicalize_url(c: Column) -> Column:
    """Lower-cased https form without one trailing slash, tracking parameters and www.

    The slash goes first, so a slash in front of a tracking parameter stays.
    """
    u = F.lower(F.coalesce(c, F.lit("")))
    for pattern, with_ in ((r"/$", ""),
                           (r"[?&](utm_[^&]+|fbclid=[^&]+|gclid=[^&]+)", ""),
                           (r"^http://", "https://"),
                           (r"://www\.", "://"),
                           (r"[?&]$", "")):
        u = F.regexp_replace(u, pattern, with_)
    return u


def with_scheme(c: Column) -> Column:
    return F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))


def host(c: Column) -> Column:
    """What stands between the scheme and the path, port included."""
    return F.regexp_extract(c, r"^[^:/?#]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)


def bare_host(c: Column) -> Column:
    """Lower-cased host without www."""
    return F.regexp_replace(F.lower(host(c)), r"^www\.", "")


def normalize_url(c: Column) -> Column:
    """https, no www, no trailing slash (root keeps one), no fragment, query kept."""
    u = F.substring_index(c, "#", 1)
    bare = F.regexp_replace(host(u), r"^www\.", "")
    trimmed = F.regexp_replace(path(u), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    return F.concat(F.lit("https://"), bare,
                    F.when(trimmed == "", "/").otherwise(trimmed),
                    F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def base_domain(c: Column) -> Column:
    """Last two labels of the host; addresses in digits stay whole; null gives ''."""
    whole = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[^:/?#]*://)?([^/?#:]*)", 1)
    last_two = r"^(?!\d{1,3}(?:\.\d{1,3}){3}$).*\.([^.]+\.[^.]+)$"
    return F.lower(F.regexp_replace(F.regexp_replace(whole, r"^www\.", ""), last_two, "$1"))


def same_site(url: Column, base: Column) -> Column:
    """Equal hosts, or the first is a subdomain of the second."""
    a, b = (F.regexp_replace(host(x), r"^www\.", "") for x in (url, base))
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b))


def is_fetchable(c: Column, endings=fv.UNFETCHABLE_ENDINGS) -> Column:
    return ~F.lower(path(c)).rlike(f"({any_of(endings)})$")


def url_path(c: Column) -> Column:
    """Host and path, for display."""
    return F.concat(host(c), path(c))


def city_from_url(c: Column) -> Column:
    """City of the first path segment that is a known slug or starts with one and a hyphen.

    One pattern finds the slug: a whole segment comes before a start of one, and slugs are tried
    in the order of the table.
    """
    slugs = "|".join(fv.CITY_BY_SLUG)
    slug = F.regexp_extract(F.lower(path(with_scheme(c))), f"/((?:{slugs})(?=/|$)|(?:{slugs})(?=-))", 1)
    cities = F.create_map(*[F.lit(x) for pair in fv.CITY_BY_SLUG.items() for x in pair])
    return F.when(slug != "", F.try_element_at(cities, slug))


def org_name(url: Column, title: Column) -> Column:
    """First host label in capitals, unless one letter or mostly digits; else the title's first word."""
    label = F.substring_index(bare_host(F.coalesce(url, F.lit(""))), ".", 1)
    digits = F.length(label) - F.length(F.regexp_replace(label, r"\d", ""))
    usable = (F.length(label) > 1) & (digits * 2 <= F.length(label))
    word = F.split(F.coalesce(title, F.lit("")), r"[\s\-|]", 2)[0]
    return F.when(usable, F.upper(label)).otherwise(word)


def side_size_from_url(c: Column) -> Column:
    """7 for 7v7, 7vs7, 7on7 or 7-v-7, when both numbers agree."""
    pattern = r"(?i)(\d+)\s*(?:v|vs|on|-v-)\s*(\d+)"
    a, b = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when((a == b) & (a != ""), a.try_cast("int"))
