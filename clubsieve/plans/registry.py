"""Where the query modules register each query and its check."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Inputs:
    """The given tables and derived views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        from . import derived
        if hasattr(derived, name):
            return getattr(derived, name)(self)
        return self.view(name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register fn(inputs) -> DataFrame under a name, with the SQL it must agree with."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn

    return wrap
