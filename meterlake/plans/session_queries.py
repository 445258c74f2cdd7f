"""Sessions, activity and the aggregates and windows under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.config import Config
from meterlake.functions.metrics import processed_of_parts
from meterlake.operators import activity, sessions, usage
from meterlake.operators.filters import Filters, apply
from meterlake.plans.facts import FACTS_SQL, facts, projects, sql_model, sql_provider, sql_ratio, table
from meterlake.plans.registry import query

ONE = "view:3"
BILLING = Config(billing=(("glm", "subscription"), ("openai", "metered")))
_PARTS = "(processed_input_tokens + output_tokens + unattributed_tokens)"

_MEASURES = f"""min(occurred_at) AS first_activity, max(occurred_at) AS last_activity, count(*) AS requests, count(DISTINCT turn_id) AS turns, count(turn_id) AS attributed_requests,
  CAST(sum({_PARTS}) AS BIGINT) AS processed_tokens, CAST(sum(processed_input_tokens) AS BIGINT) AS processed_input_tokens, CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh_input_tokens,
  CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens, CAST(sum(cache_write_input_tokens) AS BIGINT) AS cache_write_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(coalesce(reasoning_output_tokens, 0)) AS BIGINT) AS reasoning_output_tokens, count(reasoning_output_tokens) AS reasoning_available, CAST(count_if(cache_write_available) AS BIGINT) AS cache_write_available,
  CAST(sum(unattributed_tokens) AS BIGINT) AS unattributed_tokens, CAST(sum(CASE WHEN cost_available THEN cost_nano_usd END) AS BIGINT) AS cost_nano,
  CAST(count_if(cost_available AND cost_nano_usd IS NOT NULL) AS BIGINT) AS cost_available, CAST(sum(CASE WHEN cost_available THEN {_PARTS} ELSE 0 END) AS BIGINT) AS costed"""
_RATES = f"""cost_nano / 1e9::DOUBLE AS cost_usd, {sql_ratio("costed", "processed_tokens")} AS cost_coverage, {sql_ratio("cache_read_input_tokens", "processed_input_tokens")} AS cache_hit_rate"""
_STORED = "coalesce(canonical_model_id, raw_model_id, 'unknown-model')"


def sql_sessions(where: str = "TRUE", having: str = "TRUE") -> str:
    return f"""{FACTS_SQL}, listed AS (SELECT * EXCLUDE (costed), {_RATES} FROM (
    SELECT session_id, min(harness) AS harness, min(f.project_id) AS project_id, min(display_path) AS project_path, string_agg(DISTINCT coalesce({sql_model(_STORED)}, {_STORED}), ',' ORDER BY coalesce({sql_model(_STORED)}, {_STORED})) AS models,
      coalesce(list_filter(string_split(replace(min(display_path), '\\', '/'), '/'), lambda x: x <> '')[-1], 'Unassigned') AS project_name, {_MEASURES}
    FROM facts f LEFT JOIN projects p ON p.project_id = f.project_id WHERE {where} GROUP BY session_id HAVING {having}))"""


def sql_session_page(key: str, order: str, limit: int, offset: int = 0, having: str = "TRUE") -> str:
    return f"{sql_sessions(having=having)} SELECT * FROM listed ORDER BY {key} {order} NULLS LAST, session_id LIMIT {limit} OFFSET {offset}"


def _listed(spark: SparkSession, sf_dir: str, search: str = "") -> DataFrame:
    return sessions.listed(facts(spark, sf_dir), projects(spark), search=search)


@query(f"{sql_sessions()} SELECT * FROM listed")
def a5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)


_HIT = r"session_id ILIKE '%{0}%' ESCAPE '\' OR bool_or(coalesce(display_path, '') ILIKE '%{0}%' ESCAPE '\') OR bool_or(coalesce(canonical_model_id, raw_model_id, '') ILIKE '%{0}%' ESCAPE '\')"


@query(f"{sql_sessions(having=_HIT.format('PROJECT\\_100\\%'))} SELECT session_id, requests, processed_tokens FROM listed")
def f5_session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, "PROJECT_100%").select("session_id", "requests", "processed_tokens")


@query(f"{sql_sessions(having=_HIT.format('kimi'))} SELECT session_id, requests, models FROM listed")
def f5_session_search_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, "kimi").select("session_id", "requests", "models")


@query(f"{FACTS_SQL} SELECT session_id, string_agg(DISTINCT m, ',' ORDER BY m) AS models FROM facts GROUP BY 1")
def a6_session_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set(usage.model())), ",").alias("models"))


_USAGE = f"""{FACTS_SQL}, own AS (SELECT *, coalesce({sql_model(_STORED)}, {_STORED}) AS model, coalesce({sql_provider("coalesce(canonical_provider_id, raw_provider_id, 'Unknown')")}, 'unknown') AS provider FROM facts)
SELECT session_id, model, provider, * EXCLUDE (session_id, model, provider, costed), {_RATES}, CASE provider WHEN 'zai' THEN 'subscription' WHEN 'openai' THEN 'metered' ELSE 'unspecified' END AS billing_mode
FROM (SELECT session_id, model, provider, {_MEASURES} FROM own GROUP BY 1, 2, 3)"""


@query(_USAGE)
def a7_session_model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.model_usage(facts(spark, sf_dir), BILLING)


@query(f"""{FACTS_SQL}, b AS (SELECT session_id, epoch(min(occurred_at)) AS lo, epoch(max(occurred_at)) AS hi FROM facts GROUP BY 1),
w AS (SELECT session_id, CAST(floor(lo) AS BIGINT) AS start, CAST(greatest(1, ceil((hi - floor(lo) + 1) / 48)) AS BIGINT) AS width FROM b)
SELECT session_id, (CAST(floor(epoch(occurred_at)) AS BIGINT) - start) // width AS bucket, width AS bucket_seconds, min(occurred_at) AS occurred_at, CAST(sum({_PARTS}) AS BIGINT) AS processed_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS requests FROM facts JOIN w USING (session_id) GROUP BY 1, 2, 3""")
def a8_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.timeline(facts(spark, sf_dir))


@query("""SELECT e.event_type AS harness, flag, count(*) AS n FROM (SELECT event_type, unnest(list_filter([CASE WHEN k % 3 = 0 THEN 'missing-cache-write' END, CASE WHEN k % 2 = 1 THEN 'missing-reasoning' END,
  CASE WHEN event_type <> 'purchase' THEN 'missing-cost' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) e GROUP BY 1, 2""")
def a15_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("harness", F.explode("quality_flags").alias("flag")).groupBy("harness", "flag").agg(F.count("*").alias("n"))


# Windows


@query(f"""{FACTS_SQL}, s AS (SELECT session_id, m, sum({_PARTS}) AS t FROM facts GROUP BY 1, 2) SELECT session_id, m AS model FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, m) = 1""")
def w1_dominant_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = facts(spark, sf_dir).groupBy("session_id", usage.model()).agg(F.sum(processed_of_parts()).alias("t"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t"), "model"))
    return sums.withColumn("rn", first).where("rn = 1").select("session_id", "model")


@query(f"""{FACTS_SQL} SELECT session_id, project_id FROM facts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, id) = 1""")
def w2_first_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.struct("project_id"), F.struct("occurred_at", "id")).alias("p")
    return facts(spark, sf_dir).groupBy("session_id").agg(first).select("session_id", "p.project_id")


_LARGEST = f"""{FACTS_SQL}, s AS (SELECT session_id, min(occurred_at) AS started_at, CAST(sum({_PARTS}) AS BIGINT) AS processed_tokens, sum(cost_nano_usd) AS nano, count(*) AS events, max(harness) AS harness FROM facts GROUP BY 1),
md AS (SELECT session_id, model FROM (SELECT session_id, {_STORED} AS model, sum({_PARTS}) AS t FROM facts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, model) = 1),
pr AS (SELECT session_id, project_id FROM facts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, id) = 1)
SELECT session_id, started_at, harness, model, project_id, events, processed_tokens, CAST(nano AS DOUBLE) / 1e9::DOUBLE AS cost_usd FROM s LEFT JOIN md USING (session_id) LEFT JOIN pr USING (session_id)"""


@query(f"{_LARGEST} ORDER BY processed_tokens DESC, session_id LIMIT 5")
def q6_largest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.largest(facts(spark, sf_dir))


@query(f"{_LARGEST} ORDER BY processed_tokens DESC, session_id LIMIT 25")
def o7_top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.largest(facts(spark, sf_dir), limit=1000)


@query(f"""{FACTS_SQL}, m1 AS (SELECT session_id, m FROM (SELECT session_id, m, sum({_PARTS}) t FROM facts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, m) = 1),
p1 AS (SELECT session_id, project_id FROM facts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, id) = 1)
SELECT s.session_id, s.n, m1.m AS model, p1.project_id FROM (SELECT session_id, count(*) AS n FROM facts GROUP BY 1) s LEFT JOIN m1 USING (session_id) LEFT JOIN p1 USING (session_id)""")
def j4_session_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = facts(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"))
    return per.join(w1_dominant_model(spark, sf_dir), "session_id", "left").join(w2_first_project(spark, sf_dir), "session_id", "left")


# Pages


_PAGES = {"recent": "last_activity", "tokens": "processed_tokens", "cost": "cost_nano", "requests": "requests", "project": "lower(project_name)", "harness": "lower(harness)", "cache": "cache_hit_rate"}


def _page(sort: str, order: str, number: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sessions.page(_listed(spark, sf_dir), sort, number, 20, order)

    run.__name__ = f"q8_sessions_{sort}_{order}"
    query(sql_session_page(_PAGES[sort], order.upper(), 20, (number - 1) * 20))(run)


for _sort in _PAGES:
    _page(_sort, "desc", 1)
for _sort in ("cost", "project"):
    _page(_sort, "asc", 3)


@query(sql_session_page("requests", "DESC", 30, 60))
def o5_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.page(_listed(spark, sf_dir), "requests", 3, 30)


@query(f"{sql_sessions()} SELECT * FROM listed ORDER BY lower(project_name) ASC NULLS LAST, session_id LIMIT 15")
def o6_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.page(_listed(spark, sf_dir), "project", 1, 15, "asc")


@query(f"""{FACTS_SQL} SELECT id, occurred_at, {_PARTS} AS processed FROM facts WHERE session_id = '{ONE}' ORDER BY processed DESC, occurred_at, id LIMIT 5""")
def o8_largest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.largest_requests(apply(facts(spark, sf_dir), Filters(session=ONE))).select("id", "occurred_at", "processed")


# Details of one session


@query(f"{sql_sessions(where=f"session_id = '{ONE}'")} SELECT * FROM listed")
def q9_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.listed(facts(spark, sf_dir), projects(spark), Filters(session=ONE))


@query(f"{_USAGE} WHERE session_id = '{ONE}'")
def q9_session_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.model_usage(apply(facts(spark, sf_dir), Filters(session=ONE)), BILLING)


# Activity

ZONE, NOW = "Europe/Berlin", "2024-01-27T10:00:00Z"
SINCE, UNTIL = "2024-01-04T10:30:00Z", "2024-01-25T22:15:00Z"
PERIOD = Filters(since=SINCE, until=UNTIL)
_LOCAL = "timezone('Europe/Berlin', timezone('UTC', {}))"
_IN = "occurred_at >= TIMESTAMP '2024-01-04 10:30:00' AND occurred_at < TIMESTAMP '2024-01-25 22:15:00'"
_SPINE = "spine AS (SELECT strftime(unnest(generate_series(DATE '2024-01-04', DATE '2024-01-25', INTERVAL 1 DAY)), '%Y-%m-%d') AS date)"
_PER = f"""per AS (SELECT strftime({_LOCAL.format("occurred_at")}, '%Y-%m-%d') AS date, harness, count(DISTINCT session_id) AS sessions, CAST(sum({_PARTS}) AS BIGINT) AS processed_tokens, count(*) AS requests FROM facts WHERE {_IN} GROUP BY 1, 2)"""


@query(f"{FACTS_SQL}, {_PER} SELECT * FROM per")
def a9_day_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.by_harness(facts(spark, sf_dir), PERIOD, ZONE, NOW)


@query(f"""{FACTS_SQL}, {_PER}, {_SPINE} SELECT date, CAST(coalesce(sum(sessions), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(processed_tokens), 0) AS BIGINT) AS processed_tokens, CAST(coalesce(sum(requests), 0) AS BIGINT) AS requests
  FROM spine LEFT JOIN per USING (date) GROUP BY 1""")
def q11_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.daily(facts(spark, sf_dir), PERIOD, ZONE, NOW)


@query(f"""{FACTS_SQL} SELECT count(DISTINCT session_id) AS sessions, CAST(coalesce(sum({_PARTS}), 0) AS BIGINT) AS processed_tokens, count(*) AS requests, count(DISTINCT strftime({_LOCAL.format("occurred_at")}, '%Y-%m-%d')) AS active_days FROM facts WHERE {_IN}""")
def a10_period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.totals(facts(spark, sf_dir), PERIOD, ZONE, NOW)


@query(f"""{FACTS_SQL}, days AS (SELECT CAST(d AS DATE) AS day, timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP))) AS a, timezone('UTC', timezone('America/New_York', CAST(d + INTERVAL 1 DAY AS TIMESTAMP))) AS b
  FROM (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-12', INTERVAL 1 DAY)) AS d))
SELECT strftime(day, '%Y-%m-%d') AS date, count(f.id) AS requests FROM days LEFT JOIN facts f ON f.occurred_at >= a AND f.occurred_at < b GROUP BY 1""")
def j5_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range join by its day key: events meet the window whose local day is theirs."""
    f = Filters(since="2024-01-05T05:00:00Z", until="2024-01-13T05:00:00Z")
    out = activity.daily(facts(spark, sf_dir), f, "America/New_York", NOW)
    return out.select("date", "requests")


# Ancestors in conversations: a turn's parent is the one before it.


@query("""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations""")
def g1_nearest_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlake.operators.graph import nearest

    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("conv_id"), "turn", "role")
    edges = nodes.select("session", F.col("turn").cast("string").alias("node"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), "role", F.col("turn").alias("ordinal"))
    found = nearest(edges, ("user",))
    return nodes.join(found, (nodes.session == found.session) & (nodes.turn.cast("string") == found.node)).select(nodes.conv_id, nodes.turn, found.ancestor.cast("long").alias("user_turn"))


@query("""SELECT role, count(*) AS n, count(c.c_custkey) AS customers FROM conversations v LEFT JOIN customer c ON c.c_custkey = v.turn GROUP BY 1""")
def j7_message_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("turn"))
    rows = table(spark, sf_dir, "conversations").select("turn", "role").join(customers.withColumn("hit", F.lit(1)), "turn", "left")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count("hit").alias("customers"))
