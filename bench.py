"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from clubsieve.plans.catalog import QUERIES
from clubsieve.session import local_session

HEADLINE = (
    "x1_canonicalize_result_url", "x6_city_from_url", "x8_validate_url", "x10_priority", "x18_comp_level",
    "v2_quality_score", "f1_active_listings", "a2_field_coverage", "a7_duplicate_groups", "a12_url_work_list",
    "a16_gap_report", "w1_latest_checks", "w8_rank_in_query", "j1_city_from_search", "j2_urls_with_check_age",
    "j4_queue_additions", "j7_best_matches", "j9_match_divisions", "r1_duplicate_pairs", "r3_assign_groups",
    "r4_merge_groups", "r5_merge_pairs", "r8_choose_patches", "m1_insert_plan", "m15_reconcile_plan",
    "h2_html_to_main_text", "h4_page_category", "h5_page_elements", "h12_navigation_score", "e1_similar_vectors",
    "g1_crawl",
)


def calibrate(spark) -> float:
    """Seconds of a fixed job that reads nothing: a measure of the machine's load, not of the library."""
    began = time.time()
    hashed = spark.range(50_000_000).selectExpr("xxhash64(id) % 100000 AS k", "id")
    hashed.groupBy("k").agg(F.sum("id")).write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=cores, app="bench")
    QUERIES["a1_quality_summary"](spark, folder).collect()  # starts the session's caches and code generation
    calibrate(spark)  # the first run also compiles
    before = calibrate(spark)
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    after = calibrate(spark)
    total = sum(seconds.values())
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cores),
                      "calibration": {"before": before, "after": after, "total_per_second": round(total * 2 / (before + after), 1)}}))
    spark.stop()


if __name__ == "__main__":
    main()
