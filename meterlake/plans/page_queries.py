"""Pages of events from layouts in ranges, for the sorts whose keys are times, counts and costs that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.operators import events as single
from meterlake.operators import pages
from meterlake.operators.filters import Filters
from meterlake.plans import usage_queries
from meterlake.plans.facts import facts
from meterlake.plans.registry import _SQL, query


def _page(spark: SparkSession, sf_dir: str, sort: str, *args, **more) -> DataFrame:
    return usage_queries._page(pages.page(pages.laid(facts(spark, sf_dir), sort), *args, **more))


@query(_SQL["q5_events_largest"])
def pages_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "largest", size=10)


@query(_SQL["o1_keyset"])
def pages_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "largest", usage_queries.JANUARY, single.encode_cursor(9000, "5"), 1000)


@query(_SQL["o2_cost_cursor"])
def pages_cost_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "cost", cursor=single.encode_cursor(1_000_000_000, "5"), order="asc")


@query(_SQL["o2_cost_null_cursor"])
def pages_cost_null_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "cost", cursor=single.encode_cursor(None, "7"))


@query(_SQL["q10_session_requests"])
def pages_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "oldest", Filters(session="view:3"), size=10)
