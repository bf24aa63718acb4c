"""Survivorship: which value survives when records are the same listing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, keys, scoring
from .filters import missing_fields

KEPT_FROM_STORED = ("league_id", "created_at")
NOT_COPIED = ("league_id", "created_at", "updated_at", "is_archived")


def filled_count(df: DataFrame) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))


def merge_groups(df: DataFrame, group: list[str], sequence: str = "league_id") -> DataFrame:
    """One record per group: the most complete one, its nulls filled from the others in order.

    Each column is a min_by over the records that have it, so a group folds map-side and its
    size does not matter.
    """
    order = F.struct((-filled_count(df)).alias("n"), F.col(sequence).alias("s"))
    ranked = df.withColumn("_order", order)
    columns = [c for c in df.columns if c not in group]
    merged = ranked.groupBy(*group).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in columns],
        F.count("*").alias("merged_records"))
    present = sum((keys.known(F.col(f)).isNotNull().cast("int") for f in fv.KEY_FIELDS if f in df.columns), F.lit(0))
    return merged.withColumn("identifying_fields_pct", F.round(present * 100.0 / len(fv.KEY_FIELDS), 1))


def fold_partners(new: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per stored record that something merges into: its best new value of each column.

    Of all new records paired with it, a column takes its value from the best-scored one that has
    one, the least id on a tie; the score of that record stays with the value. A partial aggregate,
    so many partners of one record cost one row per task.
    """
    score = F.coalesce("quality_score", F.lit(0))
    rows = pairs.select("league_id", "match_id").join(new.withColumn("_score", score), "league_id")
    order = F.struct((-F.col("_score")).alias("s"), "league_id")
    return rows.groupBy("match_id").agg(*[
        F.min_by(F.struct(F.col(c).alias("value"), F.col("_score").alias("score")), F.when(F.col(c).isNotNull(), order)).alias(f"new_{c}")
        for c in columns])


def merge_into(new: DataFrame, old: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """The stored table with every new record of a pair (league_id, match_id) merged into its match.

    Each value comes from the best-scored record that has one, among the stored record and all of
    its partners; new ones go first on equal scores. Id and creation time stay those of the stored
    record, the score of a changed record is computed anew and the highest completeness kept.
    `merged` tells which rows changed. The stored side is read once.
    """
    columns = [c for c in old.columns if c in new.columns and c not in KEPT_FROM_STORED]
    joined = old.join(fold_partners(new, pairs, columns), F.col("league_id") == F.col("match_id"), "left")
    own = F.coalesce("quality_score", F.lit(0))

    def pick(c):
        found = F.col(f"new_{c}")
        if c == "identifying_fields_pct":
            return F.when(F.col("match_id").isNull(), F.col(c)).otherwise(
                F.greatest(F.coalesce(F.col("best_pct"), F.lit(0)), F.coalesce(F.col(c), F.lit(0))))
        return F.when(F.col(c).isNull() | (found["score"] >= own), F.coalesce(found["value"], F.col(c))).otherwise(F.col(c))

    if "identifying_fields_pct" in columns:
        best = pairs.join(new.select("league_id", "identifying_fields_pct"), "league_id").groupBy(
            F.col("match_id").alias("_target")).agg(F.max("identifying_fields_pct").alias("best_pct"))
        joined = joined.join(best, F.col("league_id") == F.col("_target"), "left")
    out = joined.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in old.columns], F.col("match_id").isNotNull().alias("merged"))
    return out.withColumn("quality_score", F.when(F.col("merged"), scoring.quality_score(out, as_of)).otherwise(F.col("quality_score")))


def merge_pairs(new: DataFrame, old: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """The merged record of each pair (league_id, match_id); `merged_from` is the new record.

    Pairs of one stored record share one merged record, see `merge_into`.
    """
    merged = merge_into(new, old, pairs, as_of).filter("merged").drop("merged")
    return pairs.select(F.col("league_id").alias("merged_from"), F.col("match_id").alias("league_id")).join(merged, "league_id")


def absorb(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table after a reviewer's merges: each keeper takes what it lacks, each duplicate is archived.

    `pairs` holds (keep_id, archive_id) and may name an `order` in which the merges were made, else the ids of the
    duplicates order them. A keeper takes each value from its first duplicate that has one. Records keep
    what they were before the merges, so what a duplicate took itself is not handed on.
    """
    columns = [c for c in df.columns if c not in NOT_COPIED]
    turn = F.struct("order", "archive_id") if "order" in pairs.columns else F.struct("archive_id")
    first = [F.min_by(f"other.`{c}`", F.when(F.col(f"other.`{c}`").isNotNull(), turn)).alias(c) for c in columns]
    givers = (pairs.join(df.select(F.col("league_id").alias("archive_id"), F.struct(*columns).alias("other")), "archive_id")
              .groupBy(F.col("keep_id").alias("league_id")).agg(*first).select("league_id", F.struct(*columns).alias("other")))
    gone = pairs.select(F.col("archive_id").alias("league_id"), F.lit(True).alias("gone")).distinct()
    out = df.join(givers, "league_id", "left").join(gone, "league_id", "left")
    return out.select(*[
        F.coalesce(F.col(c), F.col(f"other.{c}")).alias(c) if c in columns
        else (F.col(c) | F.coalesce("gone", F.lit(False))).alias(c) if c == "is_archived" else F.col(c)
        for c in df.columns])


def compare(df: DataFrame, pairs: DataFrame, fields=fv.COMPARED_FIELDS) -> DataFrame:
    """Fields on which the two records of a pair differ, one row each (null equals null)."""
    shown = [f for f in fields if f in df.columns]
    side = lambda name: df.select(F.col("league_id").alias(f"{name}_id"), F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in shown]).alias(name))
    both = pairs.join(side("keep"), "keep_id").join(side("archive"), "archive_id")
    zipped = F.explode(F.zip_with("keep", "archive", lambda a, b: F.struct(
        a["field"].alias("field"), a["value"].alias("kept_value"), b["value"].alias("other_value"))))
    return both.select("keep_id", "archive_id", zipped.alias("d")).select("keep_id", "archive_id", "d.*").filter(
        ~F.col("kept_value").eqNullSafe(F.col("other_value")))


def null_slots(df: DataFrame, fields=fv.ENRICHABLE_FIELDS) -> DataFrame:
    """(league_id, url, field) of every empty enrichable field."""
    return df.select("league_id", F.col("url_scraped").alias("url"), F.explode(missing_fields(df, fields)).alias("field"))


def choose_patches(listings: DataFrame, snapshot: DataFrame, pages: DataFrame, scraped: DataFrame) -> DataFrame:
    """Which value fills each empty field, and where it came from.

    snapshot, scraped: (league_id, field, value); pages: (url, page_order, field, value). The
    snapshot comes first. A page value applies to every listing of the URL that lacks the field,
    if no snapshot value of the URL has it; the first page wins. The scrape is used only for
    URLs whose snapshot gave nothing, and after the pages. Existing values are never replaced.
    """
    slots = null_slots(listings)
    by_url = listings.select("league_id", F.col("url_scraped").alias("url"))
    snap = snapshot.filter(F.col("value").isNotNull())
    snap_fields = snap.join(by_url, "league_id").select("url", "field").distinct()
    first_page = pages.filter(F.col("value").isNotNull()).groupBy("url", "field").agg(
        F.min_by("value", "page_order").alias("page_value")).join(snap_fields, ["url", "field"], "left_anti")
    late = (scraped.filter(F.col("value").isNotNull()).join(by_url, "league_id")
            .join(snap_fields.select("url").distinct(), "url", "left_anti").drop("url"))
    one = lambda df, name: df.groupBy("league_id", "field").agg(F.min("value").alias(name))
    joined = (slots.join(one(snap, "snap_value"), ["league_id", "field"], "left")
              .join(first_page, ["url", "field"], "left")
              .join(one(late, "late_value"), ["league_id", "field"], "left"))
    value = F.coalesce("snap_value", "page_value", "late_value")
    source = (F.when(F.col("snap_value").isNotNull(), "snapshot").when(F.col("page_value").isNotNull(), "pages")
              .when(F.col("late_value").isNotNull(), "scrape"))
    return joined.select("league_id", "field", value.alias("value"), source.alias("source"))


def patch_summary(choices: DataFrame) -> DataFrame:
    """Filled and skipped fields of each listing (18 fields at most)."""
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("field"))))
    return choices.groupBy("league_id").agg(names(F.col("value").isNotNull()).alias("filled"),
                                            names(F.col("value").isNull()).alias("skipped"))


def apply_patches(listings: DataFrame, choices: DataFrame, as_of: Column) -> DataFrame:
    """The table with the chosen values written in and the scores of changed records recomputed."""
    kinds = dict(listings.dtypes)
    fields = [f for f in fv.ENRICHABLE_FIELDS if f in kinds]
    wide = choices.filter(F.col("value").isNotNull()).groupBy("league_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"p_{f}") for f in fields], F.lit(True).alias("changed"))
    out = listings.join(wide, "league_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"p_{f}").try_cast(kinds[f])))
    scored = F.when(F.col("changed"), scoring.quality_score(out, as_of)).otherwise(F.col("quality_score"))
    return out.withColumn("quality_score", scored).select(*listings.columns)
