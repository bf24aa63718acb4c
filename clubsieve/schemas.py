"""Declared schemas. Identifiers are whole numbers here; derive them from a key, so reruns agree."""
from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

_FEE = DecimalType(10, 2)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


LISTING = _schema(
    league_id=LongType(), organization_id=StringType(), url_id=StringType(), organization_name=StringType(), url_scraped=StringType(),
    sport_name=StringType(), season_name=StringType(), sport_season_code=StringType(), season_year=IntegerType(),
    season_start_date=DateType(), season_end_date=DateType(), day_of_week=StringType(), start_time=StringType(), end_time=StringType(),
    num_weeks=IntegerType(), time_played_per_week=StringType(), stat_holidays=StringType(), venue_name=StringType(),
    source_comp_level=StringType(), standardized_comp_level=StringType(), gender_eligibility=StringType(), team_fee=_FEE,
    individual_fee=_FEE, registration_deadline=DateType(), num_teams=IntegerType(), slots_left=IntegerType(), has_referee=BooleanType(),
    requires_insurance=BooleanType(), insurance_policy_link=StringType(), players_per_side=IntegerType(), team_capacity=IntegerType(),
    tshirts_included=BooleanType(), quality_score=IntegerType(), manual_review_flag=StringType(), pages_scraped=ArrayType(StringType()),
    completeness_status=StringType(), identifying_fields_pct=DoubleType(), page_has_multi_leagues=BooleanType(), base_domain=StringType(),
    listing_type=StringType(), created_at=TimestampType(), updated_at=TimestampType(), is_archived=BooleanType())

VENUE = _schema(
    venue_id=LongType(), venue_name=StringType(), google_name=StringType(), city=StringType(), province=StringType(), address=StringType(),
    lat=DecimalType(10, 7), lng=DecimalType(10, 7), google_place_id=StringType(), confidence_score=IntegerType(),
    manually_verified=BooleanType(), raw_api_response=StringType(), sports=ArrayType(StringType()), days_of_week=ArrayType(StringType()),
    court_type_broad=StringType(), court_type_broad_conf=IntegerType(), court_type_specific=StringType(),
    court_type_specific_conf=IntegerType(), created_at=TimestampType(), updated_at=TimestampType())

QUEUE = _schema(
    scrape_id=LongType(), url=StringType(), base_domain=StringType(), source_result_id=LongType(), organization_name=StringType(),
    sport_season_code=StringType(), priority=IntegerType(), status=StringType(), scrape_attempts=IntegerType(), source=StringType(),
    created_at=TimestampType(), updated_at=TimestampType())

CHECK = _schema(
    check_id=LongType(), check_run_id=StringType(), league_id=LongType(), checked_at=TimestampType(), old_num_teams=IntegerType(),
    new_num_teams=IntegerType(), division_name=StringType(), nav_path=ArrayType(StringType()), screenshot_paths=ArrayType(StringType()),
    status=StringType(), raw_teams=ArrayType(StringType()), url_checked=StringType(), notes=StringType())
