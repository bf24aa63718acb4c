"""Data-quality scoring, completeness, bands and reconciliation rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as fv
from .codes import valid_code
from .keys import season_year
from .text import filled, strip, truthy


def types_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def present(df: DataFrame, field: str) -> Column:
    """Truthy value of a field, or false where the frame lacks the column."""
    kinds = types_of(df)
    return truthy(F.col(field), kinds[field]) if field in kinds else F.lit(False)


def not_blank(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(False)
    return F.coalesce(strip(F.col(field).cast("string")) != "", F.lit(False))


def missing_required(df: DataFrame) -> Column:
    """Names of the required fields a record lacks; a sport code stands in for the name."""
    has_sport = not_blank(df, "sport_name") | not_blank(df, "sport_season_code")
    return F.array_compact(F.array(
        F.when(~not_blank(df, "organization_name"), "organization_name"),
        F.when(~not_blank(df, "url_scraped"), "url_scraped"),
        F.when(~has_sport, "sport_name")))


def as_day(df: DataFrame, field: str) -> Column:
    """A date; text counts only in year-month-day form."""
    c = F.col(field)
    if types_of(df)[field] == "string":
        return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))
    return c.cast("date")


def penalty_rules(df: DataFrame, as_of: Column) -> list[tuple[str, Column, int]]:
    """(name, condition, points) of every quality penalty."""
    has = lambda f: present(df, f)
    rules = [(f"missing_{f}", ~has(f), 20)
             for f in ("organization_name", "sport_season_code", "url_scraped")]
    rules += [(f"missing_t1_{f}", ~has(f), 8) for f in fv.TIER_ONE_FIELDS]
    rules += [(f"missing_t2_{f}", ~has(f), 3) for f in fv.TIER_TWO_FIELDS]
    rules.append(("missing_team_fee_and_individual_fee",
                  ~has("team_fee") & ~has("individual_fee"), 8))
    rules.append(("invalid_sport_season_code",
                  has("sport_season_code") & ~valid_code(F.col("sport_season_code")), 10))
    for fee in ("team_fee", "individual_fee"):
        amount = F.col(fee).try_cast("double")
        rules.append((f"invalid_{fee}_negative_or_zero", has(fee) & (amount <= 0), 10))
        rules.append((f"invalid_{fee}_not_numeric", has(fee) & amount.isNull(), 10))
    teams = F.col("num_teams").try_cast("int")
    rules.append(("suspicious_num_teams_equals_one", has("num_teams") & (teams == 1), 15))
    rules.append(("suspicious_num_teams_out_of_range",
                  has("num_teams") & ((teams <= 0) | (teams > 1000)), 10))
    start, end = as_day(df, "season_start_date"), as_day(df, "season_end_date")
    has_start, has_end = has("season_start_date"), has("season_end_date")
    both = has_start & has_end
    rules.append(("season_end_before_season_start", both & (end < start), 15))
    rules.append(("season_duration_over_365_days", both & (F.date_diff(end, start) > 365), 5))
    rules.append(("invalid_date_format", both & (start.isNull() | end.isNull()), 10))
    age = F.date_diff(as_of, F.when(has_start, start).when(has_end, end))
    rules.append(("stale_season_over_2_years", age > 730, 30))
    rules.append(("stale_season_over_1_year", (age > 365) & (age <= 730), 20))
    return [(n, F.coalesce(c, F.lit(False)), p) for n, c, p in rules]


def quality_score(df: DataFrame, as_of: Column) -> Column:
    """100 less all penalties, kept within 0..100. The reference day is a parameter."""
    lost = F.lit(0)
    for _, condition, points in penalty_rules(df, as_of):
        lost = lost + F.when(condition, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))


def quality_penalties(df: DataFrame, as_of: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, n) for n, c, _ in penalty_rules(df, as_of)]))


def validation(df: DataFrame, as_of: Column) -> Column:
    """struct(is_valid, missing, score, errors); the score is 0 for an invalid record."""
    missing = missing_required(df)
    valid = F.size(missing) == 0
    return F.struct(
        valid.alias("is_valid"), missing.alias("missing"),
        F.when(valid, quality_score(df, as_of)).otherwise(0).alias("score"),
        F.when(~valid, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
        .alias("errors"))


def validation_report(v: Column) -> Column:
    """The validation result as a short text report."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Quality Score: "), v["score"].cast("string"), F.lit("/100")),
        F.when(F.size(v["missing"]) > 0, F.concat(F.lit("Missing Required: "), F.array_join(v["missing"], ", "))),
        F.when(v["errors"].isNotNull(), F.concat(F.lit("Errors:\n  - "), v["errors"])),
        F.when(v["is_valid"], "✅ Valid").otherwise("❌ Invalid"))


def completeness(df: DataFrame, preset: str = "nine") -> Column:
    """Percentage of identity fields present, by the nine-field or the older eight-field rule."""
    derived = season_year(F.col("season_start_date"), F.col("season_end_date"))
    if preset == "nine":
        year = F.coalesce(F.when(present(df, "season_year"), F.col("season_year")), derived)
        flags = [year.isNotNull() if f == "season_year" else filled(F.col(f)) for f in fv.KEY_FIELDS]
        return sum((c.cast("int") for c in flags), F.lit(0)) / len(flags) * 100
    any_year = present(df, "season_year") | present(df, "season_start_date") | present(
        df, "season_end_date")
    flags = [any_year if f == "season_year" else present(df, f) for f in fv.EIGHT_KEY_FIELDS]
    return F.round(sum((c.cast("int") for c in flags), F.lit(0)) / len(flags) * 100, 2)


def completeness_status(pct: Column, preset: str = "nine") -> Column:
    high, middle, low = (80, 60, 30) if preset == "nine" else (100, 80, 50)
    return (F.when(pct >= high, "COMPLETE").when(pct >= middle, "ACCEPTABLE")
            .when(pct >= low, "PARTIAL").otherwise("FAILED"))


def quality_band(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return (F.when(s < fv.REPLACE_BELOW, "THIN").when(s < fv.DEEP_BELOW, "BORDERLINE")
            .when(s < fv.SUBSTANTIAL_FROM, "ACCEPTABLE").otherwise("SUBSTANTIAL"))


def enum_or(value: Column, confidence: Column, allowed: tuple, fallback: str) -> Column:
    """Value and confidence as they are, or the fallback with confidence 0."""
    good = F.coalesce(value.isin(*allowed), F.lit(False))
    return F.struct(F.when(good, value).otherwise(fallback).alias("value"),
                    F.when(good, F.coalesce(confidence, F.lit(0))).otherwise(0).alias("confidence"))


def check_status(old: Column, new: Column) -> Column:
    return (F.when(new == 0, "NOT_FOUND").when(old.isNull(), "CHANGED")
            .when(F.abs(new - old) <= 1, "MATCH").otherwise("CHANGED"))


def contradictions(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """Names of the fields on which a new and a stored record disagree."""
    differs = lambda f: filled(new[f]) & filled(old[f]) & (F.lower(new[f]) != F.lower(old[f]))
    return F.array_compact(F.array(
        F.when(F.abs(new["num_teams"] - old["num_teams"]) > 1, "num_teams"),
        F.when(differs("day_of_week"), "day_of_week"),
        F.when(differs("venue_name"), "venue_name")))


def reconcile(conflicts: Column, old_score: Column) -> Column:
    """struct(action, reason) from the conflicts and the band of the stored record."""
    score = F.coalesce(old_score, F.lit(0))
    reason = F.concat(F.lit("contradictions: "), F.array_join(conflicts, ", "))
    calm = F.size(conflicts) == 0
    action = (F.when(calm, "MERGE").when(score < fv.REPLACE_BELOW, "REPLACE")
              .when(score < fv.DEEP_BELOW, "REVIEW").otherwise("MERGE"))
    text = (F.when(calm, "no contradiction").when(score < fv.DEEP_BELOW, reason)
            .otherwise(F.concat(F.lit("existing quality sufficient ("), score.cast("string"),
                                F.lit(") — "), reason)))
    return F.struct(action.alias("action"), text.alias("reason"))


def passes_insert_gate(pct: Column, is_child: Column) -> Column:
    return F.coalesce(pct, F.lit(0)) >= F.when(is_child, fv.INSERT_MIN_PCT_CHILD).otherwise(
        fv.INSERT_MIN_PCT)


def review_flag(method: Column, pages: Column) -> Column:
    """Whether a record came from several pages or from the main page only."""
    return F.when((method == "multi_page_selenium") & (pages > 1), "MULTI_PAGE").when(
        method == "single_page_selenium", "MAIN_PAGE_ONLY")


def venue_route(confidence: Column) -> Column:
    return F.when(confidence >= fv.VENUE_SAVE_FROM, "auto_saved").otherwise("queued")
