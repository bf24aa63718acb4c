"""What the physical plans must and must not hold."""
import pytest

from clubsieve.operators import crawl
from clubsieve.plans.catalog import QUERIES

# These run streams or write tables; what they return is a scan.
RUNS_AT_ONCE = {"s2_csv_round_trip", "s3_append_snapshots", "s8_append_links", "s9_append_checks", "st1_intake_without_repeats", "st2_latest_per_key"}
PYTHON = {"v8_venue_confidence", "h14_tab_score", "j9_match_divisions", "h5_scored_elements", "h5_page_elements", "h6_price_hints_of_elements",
          "h7_page_tables", "h8_team_counts_in_tables", "h9_listing_tables", "h10_link_contexts", "h10_discovered_links", "h18_tree_links",
          "h21_context_bundle", "r1_duplicate_pairs", "r2_duplicate_groups_of_urls", "r3_assign_groups", "r3_assign_groups_with_parents", "r3_deduplicate", "u5_similarity_ratio",
          "u5_similar_names", "h18_resolved_links", "w8_rank_of_status"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, data):
    """Plans without broadcasts by size, as over large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {n: plan_of(q(spark, data)) for n, q in QUERIES.items() if n not in RUNS_AT_ONCE}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_joins(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoop" in p] == []


def test_python_only_where_needed(plans):
    marks = ("EvalPython", "InPandas", "InArrow")
    assert {n for n, p in plans.items() if any(m in p for m in marks)} <= PYTHON


def test_no_whole_table_window(plans):
    """A window without a partition would put a table into one task."""
    for name, p in plans.items():
        for line in p.splitlines():
            if "Window [" in line and "WindowGroupLimit" not in line:
                assert "SinglePartition" not in line, name


def test_top_n_is_limited_before_the_shuffle(plans):
    for name in ("w4_best_links", "w5_top_per_category", "w6_top_with_overflow", "h24_find_lines", "e1_similar_to_each"):
        assert "WindowGroupLimit" in plans[name], name


def test_filters_and_columns_reach_the_scan(plans):
    scan = plans["s1_table_scan"]
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in scan
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plans["f16_vectors_of"]
    assert "l_extendedprice" not in plans["f17_checks_of_run"]


def test_best_rows_are_not_sorted_aggregates(plans):
    for name in ("w1_", "w2_", "w3_", "w4_", "w7_", "j4_", "j16_"):
        for found in [n for n in plans if n.startswith(name)]:
            assert "SortAggregate" not in plans[found], found


def test_applied_plans_move_little(plans):
    assert plans["m1_apply_insert_plan"].count("Exchange hashpartitioning") <= 15


def test_levels_do_not_move_the_edges(spark):
    """The plan of a level: the frontier is exchanged, the laid out edges are only read."""
    links = spark.range(1000).selectExpr("concat('https://a.com/p', id % 50) AS source_url", "cast(id AS int) AS position",
                                         "concat('https://a.com/p', id % 70) AS discovered_url", "'League' AS anchor_text")
    edges = crawl.laid_out(crawl.edges_of(links))
    frontier = spark.range(10).selectExpr("'https://a.com' AS start", "concat('https://a.com/p', id) AS parent")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = crawl.reach(frontier, edges)
        p = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == 1, p
    assert found.count() == edges.join(frontier, "parent", "left_semi").count() > 0


def test_categories_are_worked_out_once(plans):
    """A filter on the category must not be moved below its making and repeat it there."""
    for name in ("w5_top_per_category", "w6_top_with_overflow"):
        assert [line for line in plans[name].splitlines() if "Filter" in line and "RLIKE" in line] == [], name
