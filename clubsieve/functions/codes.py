"""Season-and-sport codes: one season digit and two sport digits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixed_values as fv


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lowered(table: dict) -> dict:
    """Name (lower case) to key; the later entry wins where a name repeats."""
    return {name.lower(): key for key, name in table.items()}


def valid_code(c: Column) -> Column:
    known = (F.length(c) == 3) & F.substring(c, 1, 1).isin(*fv.SEASON_BY_DIGIT) & F.substring(
        c, 2, 2).isin(*fv.SPORT_BY_NUMBER)
    return F.coalesce(known, F.lit(False))


def season_of_code(c: Column) -> Column:
    return F.when(valid_code(c), F.try_element_at(lookup(fv.SEASON_BY_DIGIT), F.substring(c, 1, 1)))


def sport_of_code(c: Column) -> Column:
    return F.when(valid_code(c), F.try_element_at(lookup(fv.SPORT_BY_NUMBER), F.substring(c, 2, 2)))


def build_code(season: Column, sport: Column) -> Column:
    """Code from names or from their digits; null when either is unknown."""
    digit = F.when(season.isin(*fv.SEASON_BY_DIGIT), season).otherwise(
        F.try_element_at(lookup(lowered(fv.SEASON_BY_DIGIT)), F.lower(season)))
    number = F.when(sport.isin(*fv.SPORT_BY_NUMBER), sport).otherwise(
        F.try_element_at(lookup(lowered(fv.SPORT_BY_NUMBER)), F.lower(sport)))
    return F.when(digit.isNotNull() & number.isNotNull(), F.concat(digit, number))


def season_label(c: Column) -> Column:
    """Season name without a leading Late, Early or Mid."""
    out = F.trim(c)
    for prefix in fv.SEASON_LABEL_PREFIXES:
        out = F.regexp_replace(out, f"(?i)^{prefix}", "")
    return out


def sports_table(spark: SparkSession) -> DataFrame:
    """The sport dictionary as a table (58 fixed rows, safe to broadcast)."""
    return spark.createDataFrame(list(fv.SPORT_BY_NUMBER.items()), "sport_code string, sport string")


def seasons_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.SEASON_BY_DIGIT.items()), "season_code string, season string")
