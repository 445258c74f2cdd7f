"""The fact table of usage events, and the adapter that derives it from the generic events table.

Stored provider and model ids are deliberately stale in places, as ids written by older versions are: queries
canonicalise when they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = """id string, raw_record_id long, harness string, occurred_at timestamp_ntz, session_id string, logical_session_id string,
turn_id string, request_id string, project_id string, raw_provider_id string, canonical_provider_id string, provider_resolution string,
raw_model_id string, canonical_model_id string, processed_input_tokens long, fresh_input_tokens long, cache_read_input_tokens long,
cache_write_input_tokens long, cache_write_available boolean, output_tokens long, reasoning_output_tokens long, unattributed_tokens long,
processed_tokens long, cost_nano_usd long, cost_available boolean, quality_flags array<string>"""

PROJECTS = (
    ("p0", "C:/Work/Project_100%"),
    ("p1", "/srv/data/app/"),
    ("p2", r"C:\Users\me\tool"),
    ("p3", "/home/a/Beta"),
    ("p4", "/home/b/alpha"),
    ("p5", "//"),
    ("p6", None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession) -> DataFrame:
    """Seven projects: a constant."""
    return spark.createDataFrame(PROJECTS, "project_id string, display_path string")


# What older versions made of these spellings.
MODELS = ("gpt-5", "~openai/gpt-5", "claude-sonnet-4-5", "glm-5.2", "moonshotai/kimi-k3", None)
ROUTED = ("gpt-5", "openai/gpt-5", "claude-sonnet-4-5", "glm-5.2", "moonshotai/kimi-k3", None)
CANONICAL = ("openai/gpt-5", "openai/gpt-5", "anthropic/claude-sonnet-4-5", "zai/glm-5.2", "moonshot/kimi-k3", None)
OWNERS = ("openai", "openai", "anthropic", "zai", "moonshot", None)


def _pick(k: Column, values: tuple[str | None, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_events from events: a projection, so filters and columns reach the scan."""
    k = F.get_json_object("props", "$.k").cast("long")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", k.alias("k"), cents.alias("cents"))
    provider = _pick(F.col("k"), ("glm", "zai-coding-plan", "openai-codex", "OpenAI", None))
    model, owner = _pick(F.col("k"), MODELS), _pick(F.col("k"), OWNERS)
    project = F.when(F.col("user_id") % 8 < 7, F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")))
    own = F.when(F.col("k") % 2 == 0, _pick(F.col("k"), CANONICAL)).otherwise(_pick(F.col("k"), ROUTED))
    stored = F.coalesce(F.lower(provider), owner)
    fresh, read, write = 100 + 10 * F.col("k"), F.col("k") * F.col("k"), F.col("k") % 4
    reasoning, paid = F.when(F.col("k") % 2 == 0, F.col("k")), F.col("event_type") == "purchase"
    written = F.col("k") % 3 != 0
    flags = F.array_compact(F.array(F.when(~written, F.lit("missing-cache-write")), F.when(reasoning.isNull(), F.lit("missing-reasoning")), F.when(~paid, F.lit("missing-cost"))))
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.lit(None).cast("long").alias("raw_record_id"),
        F.col("event_type").alias("harness"),
        F.col("ts").alias("occurred_at"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("logical_session_id"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("t"), (F.col("k") % 10).cast("string"))).alias("turn_id"),
        F.col("event_id").cast("string").alias("request_id"),
        project.alias("project_id"),
        provider.alias("raw_provider_id"),
        stored.alias("canonical_provider_id"),
        F.when(provider.isNotNull(), "source").when(owner.isNotNull(), "model-owner").otherwise("unknown").alias("provider_resolution"),
        model.alias("raw_model_id"),
        own.alias("canonical_model_id"),
        (fresh + read + write).alias("processed_input_tokens"),
        fresh.alias("fresh_input_tokens"),
        read.alias("cache_read_input_tokens"),
        write.alias("cache_write_input_tokens"),
        written.alias("cache_write_available"),
        F.col("cents").alias("output_tokens"),
        reasoning.alias("reasoning_output_tokens"),
        F.lit(0).cast("long").alias("unattributed_tokens"),
        (fresh + read + write + F.col("cents")).alias("processed_tokens"),
        (F.col("cents") * 10_000_000).alias("cost_nano_usd"),
        paid.alias("cost_available"),
        flags.alias("quality_flags"),
    )


# The same in SQL for the comparison, written on its own.


def sql_provider(x: str) -> str:
    return f"""(CASE WHEN lower(trim({x})) IN ('glm', 'zai-coding-plan') THEN 'zai' WHEN lower(trim({x})) = 'openai-codex' THEN 'openai'
      WHEN lower(trim({x})) IN ('kimi', 'kimi-coding', 'kimi-for-coding', 'moonshot-ai') THEN 'moonshot' WHEN {x} = '' THEN NULL ELSE lower(trim({x})) END)"""


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '^\s*(~\s*)*', ''))"


def sql_owner(x: str) -> str:
    family = f"split_part(lower({sql_clean(x)}), '/', -1)"
    return f"""(CASE WHEN {family} LIKE 'claude-%' THEN 'anthropic' WHEN regexp_matches({family}, '^glm-[0-9]') THEN 'zai'
      WHEN regexp_matches({family}, '^kimi-k[0-9]') THEN 'moonshot' WHEN regexp_matches({family}, '^(gpt-[0-9]|o[0-9])') THEN 'openai'
      WHEN regexp_matches({family}, '^gemini-[0-9]') THEN 'google' WHEN {family} LIKE 'deepseek-%' THEN 'deepseek'
      WHEN regexp_matches({family}, '^grok-[0-9]') OR {family} LIKE 'grok-code%' THEN 'x-ai' WHEN {family} LIKE 'minimax-%' THEN 'minimax'
      WHEN regexp_matches({family}, '^llama-[0-9]') OR regexp_matches({family}, '^muse(-|_|$)') THEN 'meta' END)"""


def sql_model(x: str) -> str:
    clean = f"lower({sql_clean(x)})"
    return f"""(CASE WHEN {clean} = '' THEN NULL WHEN {sql_owner(x)} IS NULL THEN {clean} WHEN starts_with({clean}, 'moonshotai/') THEN 'moonshot' || substr({clean}, 11)
      WHEN contains({clean}, '/') THEN {clean} ELSE {sql_owner(x)} || '/' || {clean} END)"""


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


_VALUES = ", ".join(f"('{i}', {'NULL' if p is None else chr(39) + p + chr(39)})" for i, p in PROJECTS)

#: CTEs that every comparison begins with: facts (with p and m, the provider and model at read time) and projects.
FACTS_SQL = f"""
WITH source AS (
  SELECT event_id, ts, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events
), named AS (
  SELECT *, CASE k % 5 WHEN 0 THEN 'glm' WHEN 1 THEN 'zai-coding-plan' WHEN 2 THEN 'openai-codex' WHEN 3 THEN 'OpenAI' END AS raw_provider_id,
    CASE k % 6 WHEN 0 THEN 'gpt-5' WHEN 1 THEN '~openai/gpt-5' WHEN 2 THEN 'claude-sonnet-4-5' WHEN 3 THEN 'glm-5.2' WHEN 4 THEN 'moonshotai/kimi-k3' END AS raw_model_id
  FROM source
), stored AS (
  SELECT *, coalesce(lower(raw_provider_id), {sql_owner("raw_model_id")}) AS canonical_provider_id,
    CASE WHEN k % 2 = 0 THEN {sql_model("raw_model_id")} ELSE lower({sql_clean("raw_model_id")}) END AS canonical_model_id,
    100 + 10 * k + k * k + k % 4 AS processed_input_tokens
  FROM named
), facts AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS occurred_at, event_type AS harness, event_type || ':' || user_id AS session_id,
    CAST(user_id AS VARCHAR) AS logical_session_id, CASE WHEN k % 7 <> 0 THEN 't' || (k % 10) END AS turn_id,
    CASE WHEN user_id % 8 < 7 THEN 'p' || (user_id % 8) END AS project_id, raw_provider_id, raw_model_id, canonical_provider_id, canonical_model_id,
    coalesce({sql_provider("canonical_provider_id")}, 'unknown') AS p,
    CASE WHEN canonical_model_id IS NULL THEN 'unknown' ELSE coalesce({sql_model("canonical_model_id")}, canonical_model_id) END AS m,
    processed_input_tokens, 100 + 10 * k AS fresh_input_tokens, k * k AS cache_read_input_tokens, k % 4 AS cache_write_input_tokens,
    k % 3 <> 0 AS cache_write_available, cents AS output_tokens, CASE WHEN k % 2 = 0 THEN k END AS reasoning_output_tokens,
    0 AS unattributed_tokens, processed_input_tokens + cents AS processed_tokens, cents * 10000000 AS cost_nano_usd,
    event_type = 'purchase' AS cost_available, k
  FROM stored
), projects(project_id, display_path) AS (VALUES {_VALUES})
"""
