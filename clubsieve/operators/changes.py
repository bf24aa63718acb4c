"""Inserts, updates and deletes as pure functions from a table and its changes to the next version.

Write the result to a new path and switch readers over; a job that dies half-way leaves the
current version as it was.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, keys, levels, scoring, urls
from ..functions.text import strip
from ..session import settle
from . import dedupe, matching, merge
from .filters import queue_filter
from .ranking import best_row

NUMERIC_FIELDS = {"team_fee": "double", "individual_fee": "double", "num_teams": "int", "slots_left": "int", "num_weeks": "int",
                  "players_per_side": "int", "team_capacity": "int"}
BOOLEAN_FIELDS = ("has_referee", "requires_insurance", "tshirts_included")


def conform(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of a schema: cast where possible, null where missing, extras dropped."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schema.fields])


def prepare(df: DataFrame, as_of: Column, allowed: list[str]) -> DataFrame:
    """Records ready for insertion: typed fields, derived year, domain, type and score, allowed columns only."""
    out = df
    for name, kind in NUMERIC_FIELDS.items():
        if name in out.columns:
            out = out.withColumn(name, F.col(name).try_cast(kind))
    for name in BOOLEAN_FIELDS:
        if name in out.columns and dict(out.dtypes)[name] == "string":
            out = out.withColumn(name, F.lower(name).isin("true", "yes", "1"))
    if "time_played_per_week" in out.columns:
        minutes = F.col("time_played_per_week").try_cast("int")
        out = out.withColumn("time_played_per_week", F.when(
            minutes.isNotNull(), F.concat(minutes.cast("string"), F.lit(" minutes"))).otherwise(F.col("time_played_per_week").cast("string")))
    names = [F.col(c) for c in ("league_name", "division_name") if c in out.columns]
    given = F.col("listing_type") if "listing_type" in out.columns else F.lit(None).cast("string")
    year = keys.season_year(F.col("season_start_date"), F.col("season_end_date"))
    out = out.withColumns({
        "season_year": F.coalesce(year, F.col("season_year")) if "season_year" in out.columns else year,
        "base_domain": urls.base_domain(F.col("url_scraped")),
        "listing_type": F.coalesce(F.nullif(given, F.lit("")), levels.listing_type(
            names, F.col("num_weeks"), F.col("individual_fee"), F.col("team_fee"))),
        "is_archived": F.lit(False), "created_at": as_of, "updated_at": as_of})
    out = out.withColumn("quality_score", scoring.quality_score(out, as_of))
    return out.select(*[c for c in allowed if c in out.columns])


def insert_plan(incoming: DataFrame, stored: DataFrame, is_child: Column | None = None) -> DataFrame:
    """One action per incoming record: INVALID, MERGE (with the matched id), REJECT_QUALITY or INSERT.

    All incoming records are matched against the stored table as it stands; run the batch
    deduplication first if it may repeat itself.
    """
    valid = F.size(scoring.missing_required(incoming)) == 0
    flags = incoming.select("league_id", valid.alias("valid"), scoring.completeness(incoming).alias("pct"),
                            (F.lit(False) if is_child is None else is_child).alias("is_child"))
    found = matching.best_matches(incoming, stored)
    action = (F.when(~F.col("valid"), "INVALID").when(F.col("match_id").isNotNull(), "MERGE")
              .when(scoring.passes_insert_gate(F.col("pct"), F.col("is_child")), "INSERT").otherwise("REJECT_QUALITY"))
    return flags.join(found, "league_id", "left").select(
        "league_id", action.alias("action"), F.when(F.col("valid"), F.col("match_id")).alias("match_id"), "pct")


def apply_insert_plan(incoming: DataFrame, stored: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """The stored table after the plan: every MERGE record goes into its match, every INSERT record is added.

    The plan is settled first, as it is read for both.
    """
    plan = settle(plan.select("league_id", "action", "match_id"))
    merged = merge.merge_into(incoming, stored, plan.filter("action = 'MERGE'"), as_of).drop("merged")
    new = incoming.join(plan.filter("action = 'INSERT'").select("league_id"), "league_id", "left_semi")
    return merged.unionByName(new, allowMissingColumns=True)


def set_status(df: DataFrame, condition: Column, status: str) -> DataFrame:
    """The table with a new status on the rows of a condition, and which rows changed."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({"changed": hit, "status": F.when(hit, status).otherwise(F.col("status"))})


def set_status_by_filter(queue: DataFrame, status: str, **filters) -> DataFrame:
    """A new status on every row that matches the queue filters."""
    ids = queue_filter(queue, **filters).select("scrape_id").withColumn("changed", F.lit(True))
    out = queue.join(ids, "scrape_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return out.withColumn("status", F.when(F.col("changed"), status).otherwise(F.col("status")))


def archive(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the listed ids archived."""
    gone = ids.select("league_id").distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, "league_id", "left").withColumn(
        "is_archived", F.col("is_archived") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def last_by(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last by the order column, then by all others; nulls come first."""
    values = [c for c in rows.columns if c not in keys]
    ordered = F.struct(*([order] if order else []), *values)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), ordered).alias("_last")).select(*keys, "_last.*")


def finish_runs(queue: DataFrame, outcomes: DataFrame, order: str | None = None) -> DataFrame:
    """Status of finished runs and one more attempt for each outcome (null counts as none).

    Several outcomes of one run all count; the last by `order`, a column of outcomes, gives the status. Outcomes without a
    status are left out.
    """
    known = outcomes.filter(F.col("status").isNotNull()).select("scrape_id", F.col("status").alias("_status"), *([F.col(order).alias("_order")] if order else []))
    done = last_by(known, ["scrape_id"], "_order" if order else None).select("scrape_id", "_status").join(
        known.groupBy("scrape_id").agg(F.count("*").cast("int").alias("_runs")), "scrape_id")
    out = queue.join(done, "scrape_id", "left")
    return out.withColumns({
        "scrape_attempts": F.when(F.col("_runs").isNotNull(), F.coalesce("scrape_attempts", F.lit(0)) + F.col("_runs")).otherwise(F.col("scrape_attempts")),
        "status": F.coalesce("_status", "status")}).drop("_status", "_runs")


def screen_out(queue: DataFrame, results: DataFrame, screened: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Queue without the screened rows, and results with their URLs marked as failed."""
    left = queue.join(screened.select("scrape_id"), "scrape_id", "left_anti")
    bad = screened.select(F.col("url").alias("url_canonical")).distinct().withColumn("_bad", F.lit(True))
    flagged = results.join(bad, "url_canonical", "left").withColumns({
        "validation_status": F.when(F.col("_bad"), "FAILED").otherwise(F.col("validation_status")),
        "validation_reason": F.when(F.col("_bad"), reason).otherwise(F.col("validation_reason"))}).drop("_bad")
    return left, flagged


def requeue(queue: DataFrame, urls_to_run: DataFrame) -> DataFrame:
    """Pending rows for the URLs: an update where the URL is queued, an insert where not."""
    wanted = urls_to_run.select("url").distinct().withColumn("_again", F.lit(True))
    out = queue.withColumn("_known", F.lit(True)).join(wanted, "url", "full_outer")
    return out.withColumns({
        "status": F.when(F.col("_again"), "PENDING").otherwise(F.col("status")),
        "source": F.when(F.col("_again"), "rescrape_trigger").otherwise(F.lit("queue")),
        "is_new": F.col("_known").isNull()}).drop("_again", "_known")


def venue_upsert_plan(venues: DataFrame, incoming: DataFrame) -> DataFrame:
    """Which venue each incoming row updates: by name in any case, else by place id, else a new one.

    A place id that another venue owns is never taken over: the row then keeps no place id.
    """
    by_name = venues.groupBy(F.lower("venue_name").alias("name")).agg(F.min("venue_id").alias("name_id"))
    by_place = venues.filter(F.col("google_place_id").isNotNull()).groupBy("google_place_id").agg(F.min("venue_id").alias("place_owner"))
    out = (incoming.withColumn("name", F.lower("venue_name")).join(by_name, "name", "left")
           .join(by_place, "google_place_id", "left"))
    stolen = F.col("name_id").isNotNull() & (F.col("place_owner") != F.col("name_id"))
    return out.withColumns({
        "venue_id": F.coalesce("name_id", "place_owner"),
        "action": F.when(F.col("name_id").isNotNull(), "UPDATE_BY_NAME").when(
            F.col("place_owner").isNotNull(), "UPDATE_BY_PLACE").otherwise("INSERT"),
        "new_place_id": F.when(F.coalesce(stolen, F.lit(False)), F.lit(None)).otherwise(F.col("google_place_id")),
        "province": levels.province(F.col("address")), "city": levels.city_of_address(F.col("address"))}).drop("name", "name_id", "place_owner")


VENUE_FIELDS = ("venue_name", "city", "google_name", "province", "address", "lat", "lng", "google_place_id", "confidence_score",
                "raw_api_response", "updated_at")


def apply_venue_upsert(venues: DataFrame, plan: DataFrame) -> DataFrame:
    """The venues after the plan, with every field the plan carries; names stay unique in any case.

    The batch is folded by name, then by the venue or place it goes to; the last row (highest seq,
    which is unique) wins. Rows that would give one new place id to several venues: the first keeps it.
    """
    once = best_row(plan.withColumn("_name", F.lower("venue_name")), "_name", [F.desc("seq")])
    target = (F.when(F.col("venue_id").isNotNull(), F.struct(F.lit("venue").alias("kind"), F.col("venue_id").cast("string").alias("value")))
              .when(F.col("new_place_id").isNotNull(), F.struct(F.lit("place").alias("kind"), F.col("new_place_id").alias("value")))
              .otherwise(F.struct(F.lit("name").alias("kind"), F.col("_name").alias("value"))))
    last = best_row(once.withColumn("_target", target), "_target", [F.desc("seq")])
    first = last.groupBy("new_place_id").agg(F.min("seq").alias("_first"))
    last = last.join(first, "new_place_id", "left").withColumn(
        "google_place_id", F.when(F.col("seq") == F.col("_first"), F.col("new_place_id")))
    fields = [c for c in VENUE_FIELDS if c in plan.columns]
    known = venues.columns + [c for c in fields if c not in venues.columns]
    kinds = dict(plan.dtypes) | dict(venues.dtypes)
    updates = last.filter("venue_id IS NOT NULL").select("venue_id", F.struct(*fields).alias("u"))
    joined = venues.select(*[F.col(c) if c in venues.columns else F.lit(None).cast(kinds[c]).alias(c) for c in known]).join(updates, "venue_id", "left")
    updated = joined.select(*[
        F.col(c) if c not in fields
        else F.coalesce(F.col(f"u.{c}"), F.col(c)).alias(c) if c == "google_place_id"
        else F.when(F.col("u").isNotNull(), F.col(f"u.{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in known])
    new = last.filter("venue_id IS NULL").select(*[F.col(c).cast(kinds[c]).alias(c) for c in fields])
    return updated.unionByName(new, allowMissingColumns=True)


def backfill_domain_and_type(df: DataFrame) -> DataFrame:
    """Only the rows whose domain or type changes, with the new values."""
    names = [F.col(c) for c in ("league_name", "division_name") if c in df.columns]
    domain = urls.base_domain(F.col("url_scraped"))
    kind = F.when(F.col("listing_type").isNull() | (F.col("listing_type") == "unknown"), levels.listing_type(
        names, F.col("num_weeks"), F.col("individual_fee"), F.col("team_fee"))).otherwise(F.col("listing_type"))
    out = df.select("league_id", F.col("base_domain").alias("_d"), F.col("listing_type").alias("_t"),
                    domain.alias("base_domain"), kind.alias("listing_type"))
    return out.filter(~(F.col("_d").eqNullSafe(F.col("base_domain")) & F.col("_t").eqNullSafe(F.col("listing_type")))).drop("_d", "_t")


def backfill_levels(df: DataFrame) -> DataFrame:
    """Grade of the three plain level words, and the sentinel where a record has no level."""
    blank = F.col("source_comp_level").isNull() | (strip(F.col("source_comp_level")) == "")
    word = F.lower(strip(F.col("source_comp_level")))
    grade = F.when(blank, fv.NO_LEVEL_GRADE).when(word == "competitive", "A").when(word == "intermediate", "B").when(
        word == "recreational", "C").otherwise(F.col("standardized_comp_level"))
    return df.withColumns({"standardized_comp_level": grade,
                           "source_comp_level": F.when(blank, fv.NO_LEVEL_LABEL).otherwise(F.col("source_comp_level"))})


def backfill_province(venues: DataFrame) -> DataFrame:
    return venues.withColumn("province", F.coalesce("province", levels.province(F.col("address"))))


def backfill_name(venues: DataFrame, raw: str) -> DataFrame:
    """Display name from the first result of the stored response."""
    return venues.withColumn("google_name", F.coalesce("google_name", F.get_json_object(raw, "$.results[0].name")))


def rename_domain(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("base_domain", F.when(F.col("base_domain") == old, new).otherwise(F.col("base_domain")))


def set_type_of_url(df: DataFrame, url: str, listing_type: str) -> DataFrame:
    return df.withColumn("listing_type", F.when(F.col("url_scraped") == url, listing_type).otherwise(F.col("listing_type")))


def put_reports(snapshots: DataFrame, reports: DataFrame, key: str = "gap_report", order: str | None = None) -> DataFrame:
    """Each domain's report under one key of the metadata of its newest snapshot (the least id on a tie).

    Of several reports of a domain the last by `order`, a column of reports, replaces the others.
    """
    reports = last_by(reports.select("domain", "report", *([order] if order else [])), ["domain"], order)
    newest = best_row(snapshots.select("domain", "created_at", "snapshot_id"), "domain", [F.desc("created_at"), "snapshot_id"]).drop("created_at")
    target = newest.join(reports.select("domain", "report"), "domain").select("snapshot_id", "report")
    out = snapshots.join(target, "snapshot_id", "left")
    kept = F.map_filter(F.coalesce("metadata", F.expr("map()").cast("map<string,string>")), lambda k, v: k != key)
    return out.withColumn("metadata", F.when(F.col("report").isNotNull(), F.map_concat(
        kept, F.create_map(F.lit(key), F.col("report")))).otherwise(F.col("metadata"))).drop("report")


def apply_updates(df: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Point updates by key: the columns of `updates` replace those of the matched rows, nulls included.

    Of several updates of a key the last by `order`, a column of updates that is not written, counts as a whole.
    """
    columns = [c for c in updates.columns if c not in (key, order)]
    out = df.join(last_by(updates, [key], order).select(key, F.struct(*columns).alias("_u")), key, "left")
    return out.select(*[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                        for c in df.columns])


def delete_of(df: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows that stay when everything of the given owners is deleted."""
    return df.join(owners.select(key).distinct(), key, "left_anti")


def deleted_counts(df: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return df.join(owners.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted"))


def reconcile_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What happens to each extracted record: its stored counterpart, the decision, and the insert action."""
    old = stored.select(F.col("league_id").alias("existing_id"), F.struct("num_teams", "day_of_week", "venue_name", "quality_score").alias("old"))
    fields = ("num_teams", "day_of_week", "venue_name")
    paired = matching.same_day_or_only(incoming, stored).join(old, "existing_id", "left")
    conflict = scoring.contradictions({f: F.col(f) for f in fields}, {f: F.col("old")[f] for f in fields})
    decided = paired.select("league_id", "existing_id", F.when(
        F.col("existing_id").isNotNull(), scoring.reconcile(conflict, F.col("old.quality_score"))).alias("r"))
    inserts = insert_plan(incoming, stored).select("league_id", F.col("action").alias("insert_action"), "match_id")
    decision = F.coalesce("r.action", F.lit("NEW"))
    return decided.join(inserts, "league_id").select(
        "league_id", "existing_id", decision.alias("decision"), F.col("r.reason").alias("reason"),
        F.when(decision != "REVIEW", F.col("insert_action")).alias("insert_action"),
        F.when(decision != "REVIEW", F.col("match_id")).alias("match_id"))


def write_reconciled(incoming: DataFrame, stored: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """The table after the writes of the plan: REPLACE archives the stored record, everything but REVIEW is written.

    Archiving comes first, so a record that is written into an archived one can bring it back.
    """
    replaced = plan.filter("decision = 'REPLACE'").select(F.col("existing_id").alias("league_id"))
    writes = plan.filter("insert_action IS NOT NULL").select("league_id", F.col("insert_action").alias("action"), "match_id")
    return apply_insert_plan(incoming, archive(stored, replaced), writes, as_of)


def sure_duplicates(table: DataFrame) -> DataFrame:
    """The AUTO pairs among the active records of each URL."""
    narrow = settle(table.filter(~F.col("is_archived")).select("url_scraped", "league_id", "quality_score", *fv.SIX_KEY_FIELDS))
    return dedupe.duplicate_pairs(narrow).filter("confidence = 'AUTO'")


def apply_reconcile(incoming: DataFrame, stored: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """The table after the plan is written and sure duplicates within a URL are archived."""
    current = write_reconciled(incoming, stored, settle(plan), as_of)
    return archive(current, sure_duplicates(current).select(F.col("archive_id").alias("league_id")))


def review_rows(incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows for the review queue: what the plan leaves to a person, with the whole extracted record as JSON."""
    open_ = plan.filter("decision = 'REVIEW'").select("league_id", F.col("existing_id").alias("existing_league_id"), "reason")
    records = incoming.select("league_id", F.col("url_scraped").alias("url"), F.to_json(F.struct(*incoming.columns)).alias("extracted"))
    return records.join(open_, "league_id").select("url", "extracted", "existing_league_id", "reason")


def reconcile_counters(plan: DataFrame, sure: DataFrame) -> DataFrame:
    """Run counters of a reconcile plan and of the sure duplicates found after it."""
    rows = plan.select("decision", "existing_id", "insert_action", F.lit(False).alias("sure")).unionByName(
        sure.select(F.lit(True).alias("sure")), allowMissingColumns=True)
    written = F.col("insert_action").isin("INSERT", "MERGE")
    return rows.agg(F.count_if(~F.col("sure")).alias("leagues_extracted"), F.count_if(written).alias("leagues_written"),
                    F.count_distinct(F.when(F.col("decision") == "REPLACE", F.col("existing_id"))).alias("archived"),
                    F.count_if(F.col("decision") == "REVIEW").alias("review_queued"), F.count_if("sure").alias("auto_consolidated"))


def apply_confirmed_counts(listings: DataFrame, checks: DataFrame) -> DataFrame:
    """Team counts of changed checks, newest check per listing, written to the listings."""
    good = checks.filter((F.col("status") == "CHANGED") & F.col("league_id").isNotNull() & (F.col("new_num_teams") != 0))
    updates = good.groupBy("league_id").agg(F.max_by("new_num_teams", F.struct("checked_at", "check_id", "new_num_teams")).alias("num_teams"))
    return apply_updates(listings, updates, "league_id")
