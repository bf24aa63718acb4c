"""Aggregate reports. One pass each; groups are folded map-side before the shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.codes import sports_table
from .filters import missing_fields


def share(condition: Column, digits: int = 1) -> Column:
    """Percentage of rows for which the condition holds; 0 for no rows."""
    return F.coalesce(F.round(F.try_divide(F.count_if(condition) * 100.0, F.count("*")), digits), F.lit(0.0))


def mean(total: Column, n: Column, digits: int) -> Column:
    return F.round(F.try_divide(total.cast("double"), n), digits)


def quality_summary(df: DataFrame) -> DataFrame:
    q = F.coalesce("quality_score", F.lit(0))
    return df.agg(F.count("*").alias("total"),
                  F.coalesce(mean(F.sum(q), F.count("*"), 1), F.lit(0.0)).alias("avg_score"),
                  share(q >= 70).alias("pct_good"), share(q < 50).alias("pct_poor"))


def unpivot_row(df: DataFrame, columns, name: str, value: str) -> DataFrame:
    """One row per column of a one-row frame."""
    return df.unpivot([], list(columns), name, value)


def field_coverage(df: DataFrame, fields=fv.COVERAGE_FIELDS) -> DataFrame:
    """Percentage of non-null values, one row per field, from a single scan."""
    one = df.agg(*[F.coalesce(F.round(F.try_divide(F.count(f) * 100.0, F.count("*")), 1), F.lit(0.0))
                   .alias(f) for f in fields])
    return unpivot_row(one, fields, "field", "coverage_pct")


def quality_by(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Count, mean score and share of good records by a label, lowest mean first."""
    q = F.coalesce("quality_score", F.lit(0))
    label = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("Unknown"))
    return (df.groupBy(label.alias(alias))
            .agg(F.count("*").alias("listings"), mean(F.sum(q), F.count("*"), 1).alias("avg_score"),
                 share(q >= 70).alias("pct_good"))
            .orderBy("avg_score", alias))


def distinct_values(df: DataFrame, columns) -> DataFrame:
    """(column, value) of every distinct non-empty value; arrays stay flat rows, never one big list."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "value")
    return long.filter(F.col("value") != "").distinct()


def count_by_status(df: DataFrame, statuses=fv.QUEUE_STATUSES) -> DataFrame:
    """Rows per status in one pass, with zero for a status that never occurs."""
    one = df.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return unpivot_row(one, statuses, "status", "row_count")


def copy_key(df: DataFrame, fields=fv.SIX_KEY_FIELDS) -> dict[str, Column]:
    """Key columns for exact copies: text in lower case and trimmed, null as the empty string."""
    kinds = dict(df.dtypes)
    out = {}
    for f in fields:
        c = F.coalesce(F.col(f).cast("string"), F.lit(""))
        out[f"key_{f}"] = F.trim(F.lower(c)) if kinds[f] == "string" else c
    return out


def duplicate_groups(df: DataFrame, fields=fv.SIX_KEY_FIELDS, columns=("league_id", "quality_score", "url_scraped")) -> DataFrame:
    """Members of every group of exact copies, with the group size.

    The group table has one row per key, folded map-side. Members stay rows, so a group that
    holds a large part of the table is never gathered in one place; AQE splits a hot key.
    """
    key = copy_key(df, fields)
    keyed = df.select(*columns, *[c.alias(n) for n, c in key.items()])
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return keyed.join(sizes, list(key))


def venue_progress(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Distinct venue names in total, enriched and pending, and the venues to review."""
    named = listings.filter(F.col("venue_name").isNotNull())
    names = named.groupBy("venue_name").agg(F.max(F.col("venue_id").isNotNull()).alias("linked"))
    left = names.agg(F.count("*").alias("total"), F.count_if("linked").alias("enriched"), F.lit(0).cast("bigint").alias("needs_review"))
    none = F.lit(0).cast("bigint")
    review = venues.agg(none.alias("total"), none.alias("enriched"), F.count_if(~F.col("manually_verified") & (
        F.col("confidence_score") < fv.VENUE_SAVE_FROM)).alias("needs_review"))
    total, enriched = F.sum("total"), F.sum("enriched")
    return left.unionByName(review).agg(total.alias("total"), enriched.alias("enriched"),
                                        F.greatest(total - enriched, F.lit(0)).alias("pending"),
                                        F.sum("needs_review").alias("needs_review"))


def unlinked_venue_names(listings: DataFrame) -> DataFrame:
    """Venue names without a venue, with their listing counts, most listings first."""
    return (listings.filter(F.col("venue_id").isNull() & F.col("venue_name").isNotNull())
            .groupBy("venue_name").agg(F.count("*").alias("league_count"))
            .orderBy(F.desc("league_count"), "venue_name"))


def venue_listing_stats(listings: DataFrame) -> DataFrame:
    """Listings, mean fees and distinct start times per venue (at most one entry per clock minute)."""
    return (listings.filter(F.col("venue_id").isNotNull()).groupBy("venue_id")
            .agg(F.count("*").alias("num_leagues"),
                 mean(F.sum("team_fee"), F.count("team_fee"), 2).alias("avg_team_fee"),
                 mean(F.sum("individual_fee"), F.count("individual_fee"), 2).alias("avg_individual_fee"),
                 F.array_sort(F.collect_set(F.when(F.col("start_time") != "", F.col("start_time")))).alias("hours")))


def venue_sports_and_days(listings: DataFrame) -> DataFrame:
    """Sports (58 at most) and days of the listings linked to each venue."""
    sports = F.broadcast(sports_table(listings.sparkSession))
    linked = listings.filter(F.col("venue_id").isNotNull()).withColumn(
        "sport_code", F.when(F.length("sport_season_code") == 3, F.right("sport_season_code", F.lit(2))))
    return (linked.join(sports, "sport_code", "left").groupBy("venue_id")
            .agg(F.array_sort(F.collect_set("sport")).alias("sports"),
                 F.array_sort(F.collect_set(F.when(F.col("day_of_week") != "", F.col("day_of_week")))).alias("days_of_week")))


def url_work_list(df: DataFrame) -> DataFrame:
    """Per URL: listings, mean quality of the scored ones, total and mean missing fields."""
    org = F.coalesce(F.when(F.col("organization_name") != "", F.col("organization_name")),
                     F.when(F.col("base_domain") != "", F.col("base_domain")),
                     F.substring("url_scraped", 1, 60))
    missing = F.size(missing_fields(df))
    q = F.col("quality_score")
    return (df.withColumns({"_org": org, "_missing": missing})
            .groupBy(F.col("url_scraped").alias("url"))
            .agg(F.min_by("_org", "league_id").alias("org_name"),
                 F.min_by(F.coalesce("base_domain", F.lit("")), "league_id").alias("base_domain"),
                 F.count("*").alias("league_count"),
                 F.coalesce(mean(F.sum(q), F.count(q), 0), F.lit(0.0)).cast("int").alias("avg_quality"),
                 F.sum("_missing").alias("total_missing"),
                 mean(F.sum("_missing"), F.count("*"), 0).cast("int").alias("avg_missing")))


def quality_range_by_url(df: DataFrame) -> DataFrame:
    q = F.coalesce("quality_score", F.lit(0))
    return (df.filter(~F.col("is_archived")).groupBy(F.col("url_scraped").alias("url"))
            .agg(F.count("*").alias("league_count"), F.min(q).alias("min_quality"),
                 F.max(q).alias("max_quality"))
            .orderBy("min_quality", "url"))


def domain_groups(df: DataFrame) -> DataFrame:
    """Distinct URLs and listings of each type per base domain."""
    domain = F.coalesce(F.when(F.col("base_domain") != "", F.col("base_domain")), F.lit("unknown"))
    per_url = df.groupBy(domain.alias("domain"), "url_scraped").agg(
        *[F.count_if(F.col("listing_type") == x).alias(x) for x in fv.LISTING_TYPES])
    return (per_url.groupBy("domain")
            .agg(F.count("*").alias("urls"), *[F.sum(x).alias(x) for x in fv.LISTING_TYPES])
            .orderBy("domain"))


def domain_totals(df: DataFrame) -> DataFrame:
    """Organisations and listings by type over the whole table."""
    return domain_groups(df).agg(F.count("*").alias("organizations"),
                                 *[F.sum(x).alias(x) for x in fv.LISTING_TYPES])


def domain_city_map(results: DataFrame, queries: DataFrame, domain: Column) -> DataFrame:
    """Domains whose searches name exactly one city."""
    joined = results.select(domain.alias("domain"), "query_id").distinct().join(
        queries.filter(F.col("city").isNotNull()).select("query_id", "city"), "query_id")
    return (joined.groupBy("domain").agg(F.min("city").alias("city"), F.max("city").alias("_last"))
            .filter((F.col("city") == F.col("_last")) & (F.col("domain") != "")).drop("_last"))


def gap_report(df: DataFrame, by: str, fields=tuple(fv.CATEGORY_OF_FIELD)) -> DataFrame:
    """Per group: covered and missing fields, coverage and the missing ones by category."""
    one = df.groupBy(by).agg(*[F.max(F.col(f).isNotNull()).alias(f) for f in fields])
    named = lambda fs, flag: F.array_sort(F.array_compact(F.array(
        *[F.when(F.col(f) == flag, F.lit(f)) for f in fs])))
    covered = named(fields, True)
    by_category = {c: [f for f in fields if fv.CATEGORY_OF_FIELD[f] == c] for c in fv.FIELD_CATEGORIES}
    return one.select(by, covered.alias("covered"), named(fields, False).alias("missing"),
                      F.round(F.size(covered) * 100.0 / len(fields), 1).alias("coverage_pct"),
                      *[named(fs, False).alias(f"missing_{c.lower()}") for c, fs in by_category.items()])


def coverage_by_city_and_sport(queries: DataFrame) -> DataFrame:
    return queries.groupBy("city", "sport").agg(F.count("*").alias("query_count"))


def pass_rate_by_sport(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Results and the share that passed, per sport of the query."""
    ok = F.col("validation_status") == "PASSED"
    per_query = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return (queries.join(per_query, "query_id").groupBy("sport")
            .agg(F.sum("n").alias("total_results"), F.sum("ok").alias("passed"),
                 F.round(F.try_divide(F.sum("ok") * 100.0, F.sum("n")), 1).alias("pass_rate")))


def priority_status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("priority", "status").agg(F.count("*").alias("row_count"))


def rows_per_domain(df: DataFrame, domain: Column, limit: int = 15) -> DataFrame:
    return (df.groupBy(domain.alias("domain")).agg(F.count("*").alias("row_count"))
            .orderBy(F.desc("row_count"), "domain").limit(limit))


def campaign_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Totals and pass rate per campaign label of the queries."""
    ok = F.col("validation_status") == "PASSED"
    per_query = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if("added_to_queue").alias("queued"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (queries.join(per_query, "query_id", "left").groupBy("city")
            .agg(F.count("*").alias("total_queries"),
                 F.count_if(F.col("status") == "COMPLETED").alias("completed_queries"),
                 total("n").alias("total_results"), total("ok").alias("valid_results"),
                 (total("n") - total("ok")).alias("failed_results"), total("queued").alias("added_to_queue"),
                 F.coalesce(F.round(F.try_divide(F.sum("ok") * 100.0, F.sum("n")), 1), F.lit(0.0)).alias("pass_rate")))


def batch_summary(runs: DataFrame) -> DataFrame:
    """Success rate, mean quality over the successes, and durations of processed rows."""
    good = F.count_if("success")
    q = F.coalesce(F.sum(F.when(F.col("quality_score") != 0, F.col("quality_score"))), F.lit(0))
    return runs.agg(F.count("*").alias("total"), good.alias("success"),
                    (F.count("*") - good).alias("failed"), share(F.col("success")).alias("success_rate"),
                    F.coalesce(mean(q, F.nullif(good, F.lit(0)), 0), F.lit(0.0)).alias("avg_quality"),
                    F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_duration"),
                    mean(F.sum("duration_seconds"), F.count("*"), 1).alias("avg_duration"))


def counts_of(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most common first."""
    return df.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), column)


def page_flags(df: DataFrame) -> DataFrame:
    """Per listing: whether its page has at least three listings that are 80 % complete.

    The page table is folded first and joined back, so a page with very many listings is not
    pulled into one window partition.
    """
    per_page = df.groupBy("url_scraped").agg(
        (F.count_if(F.col("identifying_fields_pct") >= 80) >= 3).alias("page_has_multi_leagues"))
    return df.join(per_page, "url_scraped")


def category_coverage(links: DataFrame, by: str, categories=fv.FIELD_CATEGORIES) -> DataFrame:
    """Links per field category for each group, zero where a category is uncovered."""
    one = links.groupBy(by).agg(*[F.count_if(F.col("field_category") == c).alias(c) for c in categories])
    return one.unpivot([by], list(categories), "field_category", "link_count").withColumn(
        "covered", F.col("link_count") > 0)


def page_completeness(df: DataFrame) -> DataFrame:
    p = F.col("identifying_fields_pct")
    return df.groupBy("url_scraped").agg(F.count("*").alias("leagues_extracted"),
                                         F.round(F.avg(p), 2).alias("avg_completeness"))


def venue_options(venues: DataFrame, columns=("court_type_broad", "court_type_specific", "province", "city"),
                  arrays=("sports",)) -> DataFrame:
    """Distinct values of the filter columns, array elements included."""
    flat = distinct_values(venues, columns)
    for a in arrays:
        flat = flat.unionByName(venues.select(F.lit(a).alias("column"), F.explode(a).alias("value")).distinct())
    return flat


def null_baseline(df: DataFrame, fields, condition: Column) -> DataFrame:
    """Nulls per field in total and under a condition, both fees missing, and two means, in one scan."""
    both = F.col("team_fee").isNull() & F.col("individual_fee").isNull()
    return df.agg(
        F.count("*").alias("total"), F.count_if(condition).alias("selected"),
        *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in fields],
        *[F.count_if(condition & F.col(f).isNull()).alias(f"selected_null_{f}") for f in fields],
        F.count_if(both).alias("null_fees"),
        F.round(F.avg("identifying_fields_pct"), 2).alias("avg_completeness"),
        mean(F.sum("quality_score"), F.count("quality_score"), 2).alias("avg_quality"))
