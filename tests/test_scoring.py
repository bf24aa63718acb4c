"""Quality score, completeness and reconciliation on hand-worked records."""
import datetime

from pyspark.sql import functions as F

from clubsieve.functions import scoring

DAY = datetime.date
SCHEMA = ("league_id bigint, organization_name string, sport_season_code string, url_scraped string, sport_name string, season_start_date date, "
          "season_end_date date, season_year int, day_of_week string, num_weeks int, venue_name string, source_comp_level string, "
          "gender_eligibility string, has_referee boolean, players_per_side int, start_time string, time_played_per_week int, "
          "registration_deadline date, num_teams int, team_fee double, individual_fee double")
FULL = dict(league_id=1, organization_name="Org", sport_season_code="201", url_scraped="https://a.com", sport_name="Soccer",
            season_start_date=DAY(2024, 5, 1), season_end_date=DAY(2024, 8, 1), season_year=2024, day_of_week="Monday", num_weeks=8,
            venue_name="Park", source_comp_level="Rec", gender_eligibility="CoEd", has_referee=True, players_per_side=5,
            start_time="19:00", time_played_per_week=60, registration_deadline=DAY(2024, 4, 1), num_teams=8, team_fee=500.0, individual_fee=None)


def frame(spark, *changes):
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**FULL, **c}[n] for n in names) for c in changes], SCHEMA)


def scores(spark, *changes):
    df = frame(spark, *[{**c, "league_id": i} for i, c in enumerate(changes)])
    day = F.lit("2024-06-01").cast("date")
    return [r[0] for r in df.orderBy("league_id").select(scoring.quality_score(df, day)).collect()]


def test_quality_score(spark):
    assert scores(
        spark, {}, {"organization_name": ""}, {"sport_season_code": None}, {"sport_season_code": "V10"}, {"has_referee": False},
        {"num_weeks": 0}, {"start_time": None}, {"team_fee": None}, {"team_fee": -1.0}, {"num_teams": 1}, {"num_teams": 1001},
        {"num_teams": -3}, {"season_end_date": DAY(2024, 4, 1)}, {"season_end_date": DAY(2025, 6, 1)},
        {"season_start_date": DAY(2022, 5, 1), "season_end_date": DAY(2022, 8, 1)},
        {"season_start_date": DAY(2023, 5, 1), "season_end_date": DAY(2023, 8, 1)},
        {"season_start_date": None}, {k: None for k in FULL if k != "league_id"},
    ) == [100, 80, 80, 90, 92, 92, 97, 92, 90, 85, 90, 90, 85, 95, 70, 80, 92, 0]


def test_dates_as_text(spark):
    df = frame(spark, {}).withColumns({"season_start_date": F.lit("soon"), "season_end_date": F.lit("2024-08-01")})
    day = F.lit("2024-06-01").cast("date")
    assert df.select(F.array_join(scoring.quality_penalties(df, day), ",")).first()[0] == "invalid_date_format"


def test_more_fields_never_score_less(spark):
    """Filling one more empty field with a sound value never lowers the score."""
    fields = ["day_of_week", "venue_name", "num_weeks", "start_time", "num_teams", "team_fee", "has_referee"]
    empty = {f: None for f in fields}
    steps = [empty]
    for f in fields:
        steps.append({**steps[-1], f: FULL[f]})
    got = scores(spark, *steps)
    assert got == sorted(got)


def test_completeness(spark):
    df = frame(spark, {}, {"venue_name": "", "num_weeks": None})
    nine = [round(r[0], 2) for r in df.select(scoring.completeness(df)).collect()]
    eight = [r[0] for r in df.select(scoring.completeness(df, "eight")).collect()]
    assert nine == [100.0, 77.78] and eight == [100.0, 75.0]
    status = lambda p, preset: df.limit(1).select(scoring.completeness_status(F.lit(p), preset)).first()[0]
    assert [status(p, "nine") for p in (80, 60, 30, 29)] == ["COMPLETE", "ACCEPTABLE", "PARTIAL", "FAILED"]
    assert [status(p, "eight") for p in (100, 99, 50, 49)] == ["COMPLETE", "ACCEPTABLE", "PARTIAL", "FAILED"]


def test_reconcile(spark):
    schema = "i int, t int, d string, v string, ot int, od string, ov string, q int"
    rows = [(0, 8, "Monday", "Park", 9, "monday", None, 10), (1, 8, "Monday", "Park", 12, "Monday", "Park", 59),
            (2, 8, "Monday", "Park", 8, "Tuesday", "Hall", 60), (3, 8, "Monday", "", 8, "Tuesday", "Hall", 75), (4, 8, "A", "B", 1, "C", "B", None)]
    df = spark.createDataFrame(rows, schema)
    new = {"num_teams": F.col("t"), "day_of_week": F.col("d"), "venue_name": F.col("v")}
    old = {"num_teams": F.col("ot"), "day_of_week": F.col("od"), "venue_name": F.col("ov")}
    got = df.select("i", scoring.reconcile(scoring.contradictions(new, old), F.col("q")).alias("r")).orderBy("i").collect()
    assert [(r.r.action, r.r.reason) for r in got] == [
        ("MERGE", "no contradiction"), ("REPLACE", "contradictions: num_teams"), ("REVIEW", "contradictions: day_of_week, venue_name"),
        ("MERGE", "existing quality sufficient (75) — contradictions: day_of_week"), ("REPLACE", "contradictions: num_teams, day_of_week")]


def test_bands_and_status(spark):
    df = spark.createDataFrame([(None,), (59,), (60,), (75,), (90,)], "s int")
    assert [r[0] for r in df.select(scoring.quality_band(F.col("s"))).collect()] == [
        "THIN", "THIN", "BORDERLINE", "ACCEPTABLE", "SUBSTANTIAL"]
    df = spark.createDataFrame([(5, 0), (None, 4), (4, 5), (4, 6)], "o int, n int")
    assert [r[0] for r in df.select(scoring.check_status(F.col("o"), F.col("n"))).collect()] == [
        "NOT_FOUND", "CHANGED", "MATCH", "CHANGED"]
