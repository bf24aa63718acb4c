"""Matching of incoming against stored listings by partly filled keys and by similar names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, keys
from ..functions.text import norm_text
from ..session import settle
from . import similar

SEPARATOR = "\u0001"


def keyed(df: DataFrame, block: str, fields=fv.KEY_FIELDS, keep=("league_id",)) -> DataFrame:
    """The key fields as text (null = wildcard) and a bit mask of the filled ones."""
    named = {f: f"k_{f}" for f in fields}
    mask = F.lit(0)
    for i, n in enumerate(named.values()):
        mask = mask + F.when(F.col(n).isNotNull(), 1 << i).otherwise(0)
    return keys.known_keys(df, named, *keep, F.col(block).alias("block")).withColumn("mask", mask)


def value_of(names: list[str], shared: Column) -> Column:
    """The key values at the set bits of a mask, as one text."""
    parts = [F.when(shared.bitwiseAND(F.lit(1 << i)) > 0, F.col(n)).otherwise("") for i, n in enumerate(names)]
    return F.concat_ws(SEPARATOR, *parts)


#: Blocks of at most so many stored and incoming records are compared record by record, within one task each.
SMALL_STORED, SMALL_INCOMING = 64, 10_000


def _in_small_blocks(inc: DataFrame, old: DataFrame, names: list[str], min_overlap: int) -> DataFrame:
    """Matching pairs of records: each incoming one meets the few stored ones of its block."""
    other = old.select(*[F.col(c).alias(f"s_{c}") for c in old.columns])
    overlap = F.bit_count(F.col("mask").bitwiseAND(F.col("s_mask")))
    agree = (F.col("block") == F.col("s_block")) & (overlap >= min_overlap)
    for n in names:
        agree = agree & F.coalesce(F.col(n) == F.col(f"s_{n}"), F.lit(True))
    return inc.join(other, agree).select("league_id", F.col("s_league_id").alias("match_id"), overlap.cast("int").alias("overlap"))


def _in_large_blocks(inc: DataFrame, old: DataFrame, names: list[str], min_overlap: int) -> DataFrame:
    """The least match of each incoming record under each stored mask of its block, without listing pairs."""
    enough = lambda m: F.bit_count(m) >= min_overlap
    masks = lambda df, name: df.groupBy("block").agg(F.collect_set("mask").alias(name))

    shared_masks = F.array_distinct(F.filter(
        F.transform("in_masks", lambda m: m.bitwiseAND(F.col("mask"))), enough))
    index = (old.join(masks(inc, "in_masks"), "block")
             .withColumn("shared", F.explode(shared_masks))
             .select("block", F.col("mask").alias("stored_mask"), "shared",
                     value_of(names, F.col("shared")).alias("value"), "league_id")
             .groupBy("block", "stored_mask", "shared", "value").agg(F.min("league_id").alias("match_id")))
    probes = (inc.join(masks(old, "old_masks"), "block")
              .withColumn("stored_mask", F.explode("old_masks"))
              .withColumn("shared", F.col("mask").bitwiseAND(F.col("stored_mask")))
              .filter(enough(F.col("shared")))
              .select("league_id", "block", "stored_mask", "shared", value_of(names, F.col("shared")).alias("value")))
    return probes.join(index, ["block", "stored_mask", "shared", "value"]).select(
        "league_id", "match_id", F.bit_count("shared").cast("int").alias("overlap"))


def best_matches(incoming: DataFrame, stored: DataFrame, block: str = "base_domain",
                 fields=fv.KEY_FIELDS, min_overlap: int = 3,
                 small: tuple[int, int] = (SMALL_STORED, SMALL_INCOMING)) -> DataFrame:
    """For each incoming record the stored one with the most equal key fields.

    Two keys match when no field filled on both sides differs and at least `min_overlap` are
    filled on both; the least id wins a tie. Wildcards are not transitive, so this is no
    groupBy; and it must not list pairs, since a block may hold a third of the table. Instead:
    which fields two records share depends only on their masks (512 at most). The stored side
    is folded to one row per (block, mask, shared fields, their values), each incoming record
    looks up one such row per stored mask of its block. Work is linear in the rows, and a hot
    block only means more rows with different join keys.

    A block with `small` stored and incoming records or fewer is compared directly, which moves each
    record once and not once per mask. The result is the same for any `small`.
    """
    names = [f"k_{f}" for f in fields]
    sized = lambda df, most: df.groupBy(F.col(block).alias("block")).count().filter(F.col("count") > most).select(F.col("block").alias("large"))
    large = settle(sized(stored, small[0]).unionByName(sized(incoming, small[1])).distinct())
    inc, old = keyed(incoming, block, fields), keyed(stored, block, fields)
    if large.isEmpty():
        found = _in_small_blocks(inc, old, names, min_overlap)
    else:
        part = lambda df, how: df.join(large, F.col("block") == F.col("large"), how)
        found = _in_small_blocks(part(inc, "left_anti"), part(old, "left_anti"), names, min_overlap).unionByName(
            _in_large_blocks(settle(part(inc, "left_semi")), settle(part(old, "left_semi")), names, min_overlap))
    # One least id per overlap and not the least pair of both: numbers fold in a hash aggregate, a struct would be sorted.
    least = [F.min(F.when(F.col("overlap") == n, F.col("match_id"))).alias(f"at_{n}") for n in range(len(names), -1, -1)]
    return found.groupBy("league_id").agg(F.max("overlap").alias("overlap"), *least).select(
        "league_id", F.coalesce(*[f"at_{n}" for n in range(len(names), -1, -1)]).alias("match_id"), "overlap")


def division_label(day: str = "day_of_week", gender: str = "gender_eligibility",
                   level: str = "source_comp_level") -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in (day, gender, level)]))


def division_pairs(extracted: DataFrame, listings: DataFrame) -> DataFrame:
    """Each division name with each label of the same URL and the least listing that bears it, copies folded."""
    labels = (listings.groupBy(F.col("url_scraped").alias("url"), division_label().alias("label"))
              .agg(F.min("league_id").alias("league_id")))
    return extracted.filter(F.col("division_name") != "").select("url", F.lower("division_name").alias("division")).distinct().join(labels, "url")


def compared(pairs: DataFrame, floor: float) -> DataFrame:
    """Distinct texts of the pairs, whatever their URL, that can reach the floor: only these are compared in Python.

    They are settled first, else the optimizer would move the filter ahead of the aggregate, onto all pairs.
    """
    texts = settle(pairs.select("division", "label").distinct())
    return similar.with_letters(similar.with_letters(texts, "division", "a"), "label", "b").filter(similar.may_reach(floor)).select("division", "label")


def match_divisions(extracted: DataFrame, listings: DataFrame, floor: float = 0.4) -> DataFrame:
    """The listing of the same URL whose day, gender and level read most like a division name.

    Both sides are folded to distinct texts per URL, pairs to distinct texts that can reach the floor. Without
    a name the only listing of the URL is taken, as the answer to an empty name, so that one join moves the
    extracted records. Ties go to the least listing.
    """
    pairs = division_pairs(extracted, listings)
    ratios = similar.ratios(compared(pairs, floor), "division", "label").filter(F.col("ratio") >= floor)
    best = pairs.join(ratios, ["division", "label"]).groupBy("url", "division").agg(F.min_by(
        F.struct("league_id", "ratio"), F.struct((-F.col("ratio")).alias("r"), "league_id")).alias("b")).select(
        F.col("url").alias("_url"), F.col("division").alias("_division"), F.round("b.ratio", 6).alias("ratio"), "b.league_id")
    single = listings.groupBy(F.col("url_scraped").alias("_url")).agg(F.count("*").alias("n"), F.min("league_id").alias("league_id")).filter("n = 1").select(
        "_url", F.lit("").alias("_division"), F.lit(None).cast("double").alias("ratio"), "league_id")
    asked = (F.col("url") == F.col("_url")) & (F.coalesce(F.lower("division_name"), F.lit("")) == F.col("_division"))
    return extracted.join(best.unionByName(single), asked, "left").select(
        "url", *[c for c in extracted.columns if c != "url"], "ratio", "league_id")


def same_day_or_only(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored record to reconcile with: the only one of the URL, else the first of the same day."""
    day = lambda: F.lower(F.coalesce("day_of_week", F.lit(""))).alias("_day")
    per_url = stored.groupBy("url_scraped").agg(F.count("*").alias("_n"), F.min("league_id").alias("_only"))
    per_day = stored.groupBy("url_scraped", day()).agg(F.min("league_id").alias("_same_day"))
    return (extracted.withColumn("_day", day()).join(per_url, "url_scraped", "left")
            .join(per_day, ["url_scraped", "_day"], "left")
            .withColumn("existing_id", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_same_day")))
            .drop("_day", "_n", "_only", "_same_day"))


def true_children(listings: DataFrame, parent_map: DataFrame) -> DataFrame:
    """Listings whose page has a parent page that lists the same sport."""
    sport = norm_text(F.col("sport_name")).alias("sport")
    parents = listings.select(F.col("url_scraped").alias("parent_url"), sport).filter("sport <> ''").distinct()
    kids = listings.select("league_id", F.col("url_scraped").alias("child_url"), sport)
    return kids.join(parent_map, "child_url").join(parents, ["parent_url", "sport"], "left_semi").select("league_id")
