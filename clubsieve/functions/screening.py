"""Search-result screening: accept or reject a URL, and rank the accepted ones."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import any_of, has_any, hits
from .urls import host


def content_of(title: Column, snippet: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(title, blank), F.lit(" "), F.coalesce(snippet, blank)))


def adult_indicators(content: Column) -> Column:
    return hits(content, fv.ADULT_WORDS) >= 2


def validation_reason(url: Column, content: Column) -> Column:
    """Why a URL is accepted or rejected: the first rule that applies. Accepted ones start with valid_."""
    u = F.lower(url)
    blocked = [F.when(u.contains(h), "review_site" if h in fv.REVIEW_HOSTS else "social_media")
               for h in fv.BLOCKED_HOSTS]
    either = lambda words: has_any(u, words) | has_any(content, words)
    on_topic = has_any(content, fv.ON_TOPIC_WORDS) | F.lower(host(url)).rlike(
        f"({any_of(fv.ACCEPTED_HOST_ENDINGS)})$")
    return F.coalesce(
        F.when(url.isNull() | (url == ""), "empty_url"),
        F.when(u.rlike(f"({any_of(fv.DOCUMENT_ENDINGS)})$"), "invalid_file_type"),
        *blocked,
        F.when(either(fv.PROFESSIONAL_WORDS), "professional_sports"),
        F.when(either(fv.YOUTH_WORDS) | content.rlike(r"\bu\d{1,2}\b"), "youth_organization"),
        F.when(has_any(content, fv.OFF_TOPIC_WORDS), "not_league_content"),
        F.when(on_topic & adult_indicators(content), "valid_adult_rec_league"),
        F.when(on_topic, "valid_league_page"),
        F.lit("not_league_content"),
    )


def priority(url: Column, content: Column, rank: Column, org: Column, reason: Column) -> Column:
    """1 (high) to 3 (low) from weighted evidence."""
    points = (
        F.when(F.upper(org).isin(*fv.KNOWN_ORGANISATIONS), 40).otherwise(0)
        + F.least(hits(content, fv.ADULT_WORDS) * 10, F.lit(30))
        + F.when(rank <= 6, 15).when(rank <= 10, 10).otherwise(5)
        + F.when(has_any(content, fv.PRIORITY_WORDS), 10).otherwise(0)
        + F.when(has_any(F.lower(url), (".org", ".ca")), 10).otherwise(0)
        + F.when(reason == "valid_adult_rec_league", 20).otherwise(0)
    )
    return F.when(points >= 40, 1).when(points >= 20, 2).otherwise(3)
