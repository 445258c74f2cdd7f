"""Derived measures of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import activity, reports, usage
from meterlake.operators.filters import Filters
from meterlake.plans.facts import FACTS_SQL, facts, sql_ratio
from meterlake.plans.registry import query
from meterlake.plans.session_queries import _PER, _SPINE, NOW, PERIOD, ZONE
from meterlake.plans.usage_queries import _DAY, sql_summary

WEEK = Filters(since="2024-01-15T00:00:00", until="2024-01-22T00:00:00")


@query(f"""{FACTS_SQL}, t AS (SELECT CAST(coalesce(sum(CASE WHEN occurred_at >= TIMESTAMP '2024-01-15' THEN processed_tokens END), 0) AS BIGINT) AS current,
  CAST(coalesce(sum(CASE WHEN occurred_at < TIMESTAMP '2024-01-15' THEN processed_tokens END), 0) AS BIGINT) AS previous FROM facts WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-22')
SELECT current, previous, {sql_ratio("current", "previous")} - 1 AS change FROM t""")
def v1_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.change(facts(spark, sf_dir), WEEK)


@query(f"""{FACTS_SQL}, s AS (SELECT CAST(sum(cache_read_input_tokens) AS BIGINT) AS cached, CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh, CAST(sum(cache_write_input_tokens) AS BIGINT) AS write,
  CAST(greatest(0, sum(output_tokens) - sum(coalesce(reasoning_output_tokens, 0))) AS BIGINT) AS visible_output, CAST(sum(coalesce(reasoning_output_tokens, 0)) AS BIGINT) AS reasoning, CAST(sum(unattributed_tokens) AS BIGINT) AS unattributed FROM facts)
SELECT component, tokens FROM (UNPIVOT s ON cached, fresh, write, visible_output, reasoning, unattributed INTO NAME component VALUE tokens)""")
def v2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.composition(facts(spark, sf_dir))


@query(f"""WITH t AS ({sql_summary("harness AS harness")}) SELECT harness, CASE WHEN processed_tokens > 0 THEN cost_usd / (CAST(processed_tokens AS DOUBLE) / 1000000) END AS cost_per_million FROM t""")
def v3_cost_per_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.summary(facts(spark, sf_dir), by={"harness": F.col("harness")})
    return rows.select("harness", reports.cost_per_million("cost_usd", "processed_tokens").alias("cost_per_million"))


@query(f"""WITH t AS ({sql_summary("harness AS harness")}) SELECT harness, cost_usd / greatest(0.05::DOUBLE, 1 - cache_hit_rate) AS uncached_cost, greatest(0::DOUBLE, cost_usd / greatest(0.05::DOUBLE, 1 - cache_hit_rate) - cost_usd) AS savings FROM t""")
def v4_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.summary(facts(spark, sf_dir), by={"harness": F.col("harness")})
    return rows.select("harness", reports.uncached_cost("cost_usd", "cache_hit_rate").alias("uncached_cost"), reports.savings("cost_usd", "cache_hit_rate").alias("savings"))


@query(f"""{FACTS_SQL} SELECT m AS series, CAST(sum(processed_tokens) AS DOUBLE) AS score FROM facts GROUP BY 1 ORDER BY score DESC, series LIMIT 3""")
def v5_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_series(usage.series_points(facts(spark, sf_dir), "processedTokens", "model"), 3)


@query(f"""{FACTS_SQL} SELECT harness AS series, round(CAST(sum(cache_read_input_tokens) AS DOUBLE) / CAST(sum(processed_input_tokens) AS DOUBLE), 9) AS score FROM facts GROUP BY 1 ORDER BY score DESC, series LIMIT 4""")
def v5_top_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = usage.series_points(facts(spark, sf_dir), "cacheHitRate", "harness")
    return reports.top_series(points, 4, rate=True).select("series", F.round("score", 9).alias("score"))


@query(f"""{FACTS_SQL} SELECT {_DAY} AS date, round(CAST(sum(cache_read_input_tokens) AS DOUBLE) / CAST(sum(processed_input_tokens) AS DOUBLE), 9) AS value FROM facts GROUP BY 1""")
def v6_daily_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = usage.series_points(facts(spark, sf_dir), "cacheHitRate", "model")
    return reports.daily_total(points, rate=True).select("date", F.round("value", 9).alias("value"))


@query(f"""{FACTS_SQL} SELECT {_DAY} AS date, CAST(sum(processed_tokens) AS DOUBLE) AS value FROM facts GROUP BY 1""")
def v6_daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_total(usage.series_points(facts(spark, sf_dir), "processedTokens", "provider"))


@query(f"""WITH t AS ({sql_summary("harness AS harness")}), long AS (
  SELECT harness, 'cache_hit_rate' AS metric, cache_hit_rate AS value, TRUE AS enough, FALSE AS low FROM t
  UNION ALL SELECT harness, 'output_input_ratio', output_input_ratio, TRUE, FALSE FROM t
  UNION ALL SELECT harness, 'cost_per_million', CASE WHEN processed_tokens > 0 THEN cost_usd / (CAST(processed_tokens AS DOUBLE) / 1000000) END, coalesce(cost_coverage >= 0.5, FALSE), TRUE FROM t
  UNION ALL SELECT harness, 'adjusted_lift', NULL, FALSE, FALSE FROM t), s AS (SELECT *, enough AND value IS NOT NULL AS scored FROM long),
o AS (SELECT *, CASE WHEN scored THEN CASE WHEN low THEN -value ELSE value END END AS own FROM s)
SELECT harness, metric, value, scored, coalesce(scored AND count(own) OVER (PARTITION BY metric) > 1 AND own = max(own) OVER (PARTITION BY metric), FALSE) AS best FROM o""")
def v7_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.summary(facts(spark, sf_dir), by={"harness": F.col("harness")})
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"cost_per_million": reports.cost_per_million("cost_usd", "processed_tokens"), "adjusted_lift": none, "comparison_coverage": none})
    out = reports.comparison(rows)
    return out.withColumn("best", F.coalesce("best", F.lit(False)))


@query(f"""{FACTS_SQL}, s AS (SELECT m, CAST(sum(processed_tokens) AS BIGINT) AS t, sum(CASE WHEN cost_available THEN processed_tokens ELSE 0 END) AS costed FROM facts GROUP BY 1)
SELECT m AS model, t AS processed_tokens, CAST(t AS DOUBLE) / CAST(sum(t) OVER () AS DOUBLE) AS share, costed > 0 AND CAST(costed AS DOUBLE) / CAST(t AS DOUBLE) < 0.99 AS partial_cost FROM s""")
def v8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shares(usage.models(facts(spark, sf_dir)))


_DAILY = f"{FACTS_SQL}, {_PER}, {_SPINE}, daily AS (SELECT date, CAST(coalesce(sum(processed_tokens), 0) AS BIGINT) AS processed_tokens FROM spine LEFT JOIN per USING (date) GROUP BY 1)"


@query(f"""{_DAILY}, a AS (SELECT list(processed_tokens ORDER BY processed_tokens) AS s FROM daily WHERE processed_tokens > 0), c AS (SELECT s[least(len(s), CAST(floor(0.25 * len(s)) AS INT) + 1)] AS q1, s[least(len(s), CAST(floor(0.5 * len(s)) AS INT) + 1)] AS q2,
  s[least(len(s), CAST(floor(0.75 * len(s)) AS INT) + 1)] AS q3 FROM a)
SELECT date, processed_tokens, CAST(CASE WHEN processed_tokens <= 0 THEN 0 ELSE 1 + (processed_tokens > q1)::INT + (processed_tokens > q2)::INT + (processed_tokens > q3)::INT END AS INT) AS level FROM daily, c""")
def v9_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.intensity(activity.daily(facts(spark, sf_dir), PERIOD, ZONE, NOW))


@query(f"""{_DAILY}, f AS (SELECT min(CAST(date AS DATE)) AS first FROM daily) SELECT date, CAST(floor((date_diff('day', first, CAST(date AS DATE)) + (dayofweek(first) + 6) % 7) / 7) AS INT) AS week,
  CAST((date_diff('day', first, CAST(date AS DATE)) + (dayofweek(first) + 6) % 7) % 7 AS INT) AS row FROM daily, f""")
def v10_week_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.week_grid(activity.daily(facts(spark, sf_dir), PERIOD, ZONE, NOW))
