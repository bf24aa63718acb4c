"""The nine-field identity of a listing, and labels made from it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as fv
from .text import norm_text, norm_texts, strip, title_case

INTEGER_KEYS = ("season_year", "num_weeks", "players_per_side")


def season_year(start: Column, end: Column) -> Column:
    """Greatest leading year of the two dates."""
    year = lambda c: F.split(c.cast("string"), "-")[0].try_cast("int")
    return F.greatest(year(start), year(end))


def key_columns(start="season_start_date", end="season_end_date", fields=fv.KEY_FIELDS) -> dict[str, Column]:
    """Normalised key fields by name; the year comes from the dates."""
    out = {}
    for f in fields:
        if f == "season_year":
            out[f] = season_year(F.col(start), F.col(end))
        elif f in INTEGER_KEYS:
            out[f] = F.col(f).try_cast("int")
        else:
            out[f] = norm_text(F.col(f))
    return out


def uniqueness_key(**names) -> Column:
    return F.struct(*[c.alias(n) for n, c in key_columns(**names).items()])


def known(c: Column) -> Column:
    """The key value as text, null for the wildcards (null, empty, 'none')."""
    s = c.cast("string")
    return F.when(~strip(s).isin("", "none"), s)


def known_keys(df: DataFrame, names: dict[str, str], *keep) -> DataFrame:
    """`keep` and the key fields as text under new names (field to name), null for the wildcards.

    Texts are normalised in an array: written out per field, the patterns make one generated method that is too long for
    the JVM to compile, and run interpreted. A normalised text has no white space at its ends, and a number is no
    wildcard, so neither is stripped once more.
    """
    columns = key_columns(fields=tuple(f for f in names if f in INTEGER_KEYS))
    texts = [f for f in names if f not in columns]
    out = df.select(*keep, *[c.cast("string").alias(names[f]) for f, c in columns.items()], F.transform(
        norm_texts(F.array(*[F.col(f).cast("string") for f in texts]).cast("array<string>")),
        lambda s: F.when(~s.isin("", "none"), s)).alias("_texts"))
    return out.select(*[c for c in out.columns if c not in (*names.values(), "_texts")],
                      *[F.col("_texts")[texts.index(f)].alias(n) if f in texts else F.col(n) for f, n in names.items()])


def display_name(side="players_per_side", sport="sport_name",
                 others=("day_of_week", "source_comp_level", "gender_eligibility"),
                 org="organization_name") -> Column:
    n = F.col(side)
    parts = [F.when(n != 0, F.concat(n.cast("string"), F.lit("v"), n.cast("string")))]
    parts += [F.when(F.col(f) != "", title_case(F.col(f))) for f in (sport, *others)]
    return F.when(F.coalesce(*parts).isNull(), F.coalesce(F.col(org), F.lit("Unknown"))).otherwise(
        F.concat_ws(" | ", *parts))


def key_label(key: Column) -> Column:
    """Short one-line form of a key for logs."""
    shown = (("org", "organization_name", 20), ("sport", "sport_name", 15), ("year", "season_year", None),
             ("venue", "venue_name", 20), ("dow", "day_of_week", 3), ("level", "source_comp_level", 3),
             ("gender", "gender_eligibility", 3), ("weeks", "num_weeks", None),
             ("pps", "players_per_side", None))
    parts = []
    for label, field, width in shown:
        v = F.coalesce(key[field].cast("string"), F.lit("None"))
        parts.append(F.concat(F.lit(f"{label}="), v if width is None else F.substring(v, 1, width)))
    return F.concat_ws(" | ", *parts)


def search_text(city: Column, sport: Column, season: Column) -> Column:
    return F.concat_ws(" ", city, F.nullif(season, F.lit("")), sport, F.lit("league"))


def fingerprint(city: Column, state: Column, country: Column, sport: Column, season: Column,
                year: Column) -> Column:
    """Six lower-cased parts joined by a bar; missing parts stay empty."""
    clean = lambda c: strip(F.lower(F.coalesce(c, F.lit(""))))
    text_year = F.when(year != 0, year.cast("string"))
    return F.concat_ws("|", *[clean(c) for c in (city, state, country, sport, season)],
                       F.coalesce(text_year, F.lit("")))
