"""Competition levels, listing types and address parts."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .codes import lookup
from .text import strip


def comp_level(c: Column) -> Column:
    """Grade of a level label: exact label, else base word and modifier, else slash parts."""
    key = F.lower(strip(c))
    words, parts = F.split(key, r"\s+"), F.transform(F.split(key, "/"), strip)
    grade = lambda arr: F.array_compact(
        F.transform(arr, lambda w: F.try_element_at(lookup(fv.LEVEL_BY_WORD), w)))
    sign = F.array_compact(F.transform(
        words, lambda w: F.when(w.isin(*fv.LEVEL_UP_WORDS), "+").when(w.isin(*fv.LEVEL_DOWN_WORDS), "-")))
    worded = F.concat(F.get(grade(words), F.lit(0)), F.coalesce(F.get(sign, F.lit(0)), F.lit("")))
    slashed = F.when(key.contains("/"), F.concat(F.array_min(grade(parts)), F.lit("+")))
    return F.when(key != "", F.coalesce(
        F.try_element_at(lookup(fv.LEVEL_BY_LABEL), key), worded, slashed))


def default_source_level(source: Column) -> Column:
    return F.when(source.isNull() | (strip(source) == ""), fv.NO_LEVEL_LABEL).otherwise(source)


def standard_level(source: Column, proposed: Column | None = None) -> Column:
    """A proposed single letter if sound, else the rule; the default grade without a label."""
    ruled = comp_level(source)
    if proposed is not None:
        ruled = F.coalesce(F.when(proposed.rlike(r"^\p{L}$"), F.upper(proposed)), ruled)
    return F.when(source.isNull() | (strip(source) == ""), fv.NO_LEVEL_GRADE).otherwise(ruled)


def listing_type(names: list[Column], num_weeks: Column, individual_fee: Column,
                 team_fee: Column) -> Column:
    """drop_in, league or unknown, by the first rule that applies."""
    text = F.concat_ws(" ", *names) if names else F.lit("")
    short = num_weeks.isNull() | (num_weeks <= 1)
    cheap = F.coalesce(individual_fee < fv.DROP_IN_PRICE_BELOW, F.lit(False))
    seasonal = F.coalesce(num_weeks >= fv.SEASON_MIN_WEEKS, F.lit(False)) | F.coalesce(
        team_fee > 0, F.lit(False))
    return (F.when(text.rlike(f"(?i){fv.DROP_IN_PATTERN}"), "drop_in")
            .when(short & cheap, "drop_in").when(seasonal, "league").otherwise("unknown"))


PROVINCE_PATTERN = r",\s*(" + "|".join(fv.PROVINCES) + r")\s+"


def province(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, PROVINCE_PATTERN, 1), F.lit(""))


def city_of_address(address: Column) -> Column:
    """The part between commas that stands right before the province."""
    before = F.regexp_extract(address, r"(?s)^(.*?)" + PROVINCE_PATTERN, 1)
    return F.when(address.rlike(PROVINCE_PATTERN), strip(F.substring_index(before, ",", -1)))
