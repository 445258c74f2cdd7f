"""Summaries, series, models, attribution and activity that read a rollup of the events and not the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.operators import activity, rollup, usage
from meterlake.operators.filters import Filters
from meterlake.plans import registry, session_queries, usage_queries
from meterlake.plans.facts import facts
from meterlake.plans.registry import query
from meterlake.session import written

SQL = registry._SQL
#: A period that cuts a quarter of an hour at both ends.
RAGGED = Filters(since="2024-01-05T00:07:30", until="2024-01-20T12:01:00Z", harness=("view", "purchase"))
_RAGGED_SQL = "occurred_at >= TIMESTAMP '2024-01-05 00:07:30' AND occurred_at < TIMESTAMP '2024-01-20 12:01:00' AND harness IN ('view', 'purchase')"


def rolled(spark: SparkSession, sf_dir: str) -> rollup.Rollup:
    return rollup.rolled(facts(spark, sf_dir), written)


@query(SQL["q1_summary"])
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(rollup.rows(rolled(spark, sf_dir), usage_queries.JANUARY), usage_queries.JANUARY)


@query(usage_queries.sql_summary("p AS provider", _RAGGED_SQL))
def rollup_summary_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters that the period cuts come from the events, the others from the rollup."""
    return usage.summary(rollup.rows(rolled(spark, sf_dir), RAGGED), RAGGED, by={"provider": usage.provider()})


@query(SQL["q2_series_provider_requests"])
def rollup_series_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.timeseries(rollup.rows(rolled(spark, sf_dir), who=False), "requests", "provider")


@query(SQL["q2_series_model_cacheHitRate"])
def rollup_series_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.timeseries(rollup.rows(rolled(spark, sf_dir), who=False), "cacheHitRate", "model")


@query(SQL["q2_series_provider_costUsd"])
def rollup_series_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.timeseries(rollup.rows(rolled(spark, sf_dir), who=False), "costUsd", "provider")


@query(SQL["q3_models"])
def rollup_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.models(rollup.rows(rolled(spark, sf_dir)), config=usage_queries.BILLING)


@query(SQL["q4_attribution_cells"])
def rollup_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.attribution_cells(rollup.rows(rolled(spark, sf_dir), who=False), **usage_queries._SMALL)


@query(SQL["q7_models"])
def rollup_model_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.model_dimension(rollup.rows(rolled(spark, sf_dir), who=False))


@query(SQL["q11_activity"])
def rollup_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_queries
    return activity.daily(rollup.rows(rolled(spark, sf_dir), s.PERIOD), s.PERIOD, s.ZONE, s.NOW)


@query(SQL["a10_period_totals"])
def rollup_activity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_queries
    return activity.totals(rollup.rows(rolled(spark, sf_dir), s.PERIOD), s.PERIOD, s.ZONE, s.NOW)
