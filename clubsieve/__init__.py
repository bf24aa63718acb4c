"""Spark jobs that clean, score, match, merge and report on crawled listing data."""
