"""Responses of outside services, stored as text, turned into rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEARCH_SCHEMA = "organic array<struct<link string, position int, title string, snippet string>>"
PLACES_SCHEMA = ("results array<struct<place_id string, name string, formatted_address string, "
                 "geometry struct<location struct<lat double, lng double>>, types array<string>, user_ratings_total int>>")


def search_results(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Organic results of search responses; entries without link or position are dropped."""
    rows = df.select(*keep, F.explode(F.from_json(text, SEARCH_SCHEMA)["organic"]).alias("r"))
    return rows.filter((F.col("r.link") != "") & F.col("r.position").isNotNull()).select(
        *keep, F.col("r.link").alias("url_raw"), F.coalesce("r.title", F.lit("")).alias("page_title"),
        F.coalesce("r.snippet", F.lit("")).alias("page_snippet"), (F.col("r.position") + 1).alias("search_rank"))


def first_place(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The first result of places responses as flat columns."""
    r = F.get(F.from_json(text, PLACES_SCHEMA)["results"], F.lit(0))
    return df.select(*keep, r.alias("r")).select(
        *keep, "r.place_id", "r.name", "r.formatted_address", F.col("r.geometry.location.lat").alias("lat"),
        F.col("r.geometry.location.lng").alias("lng"), F.coalesce("r.types", F.array().cast("array<string>")).alias("types"),
        F.coalesce("r.user_ratings_total", F.lit(0)).alias("user_ratings_total"))


def sound_json(c: Column) -> Column:
    """The JSON text of a response: as it is, without its code fence, from the first brace to the
    last, or cut at its last complete record."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    cut = F.concat(F.regexp_extract(inner, r"(?s)^(.*\}),", 1), F.lit("\n  ]\n}"))
    good = lambda t: F.when((t != "") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(good(F.trim(c)), good(fenced), good(inner), good(cut))


def extracted_records(df: DataFrame, text: str, record: str, keep: list[str], field: str = "leagues") -> DataFrame:
    """Records of extraction responses. `record` is the field list of one record, such as
    'organization_name string, num_weeks int'; an array, a single object under the field, or a
    bare array are all accepted."""
    whole = df.select(*keep, sound_json(F.col(text)).alias("_json"))
    j = F.col("_json")
    many = F.from_json(j, f"{field} array<struct<{_fields(record)}>>")[field]
    single = F.from_json(j, f"{field} struct<{_fields(record)}>")[field]
    bare = F.when(F.ltrim(j).startswith("["), F.from_json(j, f"array<struct<{_fields(record)}>>"))
    records = F.coalesce(bare, many, F.when(single.isNotNull(), F.array(single)))
    return whole.select(*keep, F.explode(records).alias("r")).select(*keep, "r.*")


def _fields(record: str) -> str:
    """'a string, b int' in the form a struct type takes."""
    return ", ".join(f"{n}: {k}" for n, k in (part.split() for part in record.split(",")))
