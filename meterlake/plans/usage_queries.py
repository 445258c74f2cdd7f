"""Filters, canonical ids, summaries, series, models, attribution, events and dimensions over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions import canonical
from meterlake.functions.config import Config, ModelAlias, Override
from meterlake.functions.metrics import METRICS, costed, processed_of_parts, ratio, to_nano, to_usd, total
from meterlake.operators import events as single
from meterlake.operators import usage
from meterlake.operators.filters import Filters, apply
from meterlake.plans.facts import FACTS_SQL, facts, projects, sql_model, sql_owner, sql_provider, sql_ratio, table
from meterlake.plans.registry import query

JANUARY = Filters(since="2024-01-05", until="2024-01-20T12:00:00Z")
WHERE_JANUARY = "occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20 12:00:00'"
BILLING = Config(billing=(("openai", "subscription"), ("Zai", "metered")), provider_aliases=(("glm", "GLM plan"), ("openai", "OpenAI"), ("zai-coding-plan", "Coding plan")))
PLAIN = "id, harness, occurred_at, session_id, processed_tokens"


def sql_summary(keys: str = "", where: str = "TRUE") -> str:
    select, group = (f"{keys}, ", f"GROUP BY {', '.join(str(i + 1) for i in range(keys.count(' AS ')))}") if keys else ("", "")
    names = "".join(f"{k.split(' AS ')[1].split(',')[0].strip()}, " for k in keys.split(";")) if keys else ""
    sums = ", ".join(
        f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {n}"
        for n, e in {
            "processed_tokens": "processed_tokens",
            "processed_input_tokens": "processed_input_tokens",
            "fresh_input_tokens": "fresh_input_tokens",
            "cache_read_input_tokens": "cache_read_input_tokens",
            "cache_write_input_tokens": "cache_write_input_tokens",
            "output_tokens": "output_tokens",
            "reasoning_output_tokens": "reasoning_output_tokens",
            "unattributed_tokens": "unattributed_tokens",
            "requests": "1",
            "reasoning_available": "CASE WHEN reasoning_output_tokens IS NOT NULL THEN 1 END",
            "cache_write_available": "CASE WHEN cache_write_available THEN 1 END",
            "cost_available": "CASE WHEN cost_available THEN 1 END",
            "cost_nano": "CASE WHEN cost_available THEN cost_nano_usd END",
            "costed": "CASE WHEN cost_available THEN processed_tokens END",
            "cw_read": "CASE WHEN cache_write_available THEN cache_read_input_tokens END",
            "cw_write": "CASE WHEN cache_write_available THEN cache_write_input_tokens END",
        }.items()
    )
    return f"""{FACTS_SQL}, sums AS (
  SELECT {select}{sums}, count(DISTINCT session_id) AS sessions, count(DISTINCT turn_id) AS turns FROM facts WHERE {where} {group}
) SELECT {names}processed_tokens, processed_input_tokens, fresh_input_tokens, cache_read_input_tokens, cache_write_input_tokens, output_tokens,
  reasoning_output_tokens, unattributed_tokens, requests, reasoning_available, cache_write_available, cost_available, sessions, turns,
  cost_nano / 1e9::DOUBLE AS cost_usd, {sql_ratio("cache_read_input_tokens", "processed_input_tokens")} AS cache_hit_rate,
  CASE WHEN requests > 0 AND cache_write_available = requests AND cw_write > 0 THEN CAST(cw_read AS DOUBLE) / CAST(cw_write AS DOUBLE) END AS cache_reuse_efficiency,
  {sql_ratio("output_tokens", "processed_input_tokens")} AS output_input_ratio, {sql_ratio("costed", "processed_tokens")} AS cost_coverage,
  {sql_ratio("(processed_input_tokens + output_tokens)", "processed_tokens")} AS classification_coverage FROM sums"""


# Filters


@query(f"{FACTS_SQL} SELECT {PLAIN} FROM facts WHERE {WHERE_JANUARY} AND harness IN ('view', 'purchase') AND project_id IN ('p1', 'p4')")
def f1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Filters(since=JANUARY.since, until=JANUARY.until, harness=("view", "purchase"), project=("p1", "p4"))
    return apply(facts(spark, sf_dir), f).select(*PLAIN.split(", "))


@query(f"{FACTS_SQL} SELECT {PLAIN}, canonical_provider_id FROM facts WHERE p IN ('zai', 'moonshot')")
def f2_provider_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(facts(spark, sf_dir), Filters(provider=("GLM", "kimi-coding"))).select(*PLAIN.split(", "), "canonical_provider_id")


@query(f"{FACTS_SQL} SELECT {PLAIN}, canonical_model_id FROM facts WHERE m IN ('openai/gpt-5', 'moonshot/kimi-k3')")
def f3_model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(facts(spark, sf_dir), Filters(model=("gpt-5", "moonshotai/kimi-k3"))).select(*PLAIN.split(", "), "canonical_model_id")


@query(f"{FACTS_SQL} SELECT m AS model, CAST(sum(processed_tokens) AS BIGINT) AS processed_tokens FROM facts GROUP BY m HAVING sum(processed_tokens) > 0")
def f6_positive_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = facts(spark, sf_dir).groupBy(usage.model()).agg(F.sum("processed_tokens").alias("processed_tokens"))
    return agg.where("processed_tokens > 0")


@query(f"""{FACTS_SQL}, days AS (SELECT strftime(timezone('Europe/Berlin', timezone('UTC', occurred_at)), '%Y-%m-%d') AS date, p AS series, sum(cache_read_input_tokens) AS r,
  sum(CASE WHEN k % 5 = 0 THEN 0 ELSE processed_input_tokens END) AS i FROM facts GROUP BY 1, 2)
SELECT date, series, CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS value, CAST(i AS BIGINT) AS input_tokens FROM days WHERE i > 0""")
def f7_rate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    dropped = F.col("raw_provider_id") == "glm"
    rows = rows.withColumn("processed_input_tokens", F.when(dropped, 0).otherwise(F.col("processed_input_tokens")))
    return usage.series_points(rows, "cacheHitRate", "provider").drop("value_usd")


@query(f"""{FACTS_SQL} SELECT id, {sql_provider("canonical_provider_id")} AS canonical_provider_id, {sql_model("canonical_model_id")} AS canonical_model_id, cost_nano_usd FROM facts""")
def f8_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.read(facts(spark, sf_dir)).select("id", "canonical_provider_id", "canonical_model_id", "cost_nano_usd")


@query("""SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def f9_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rest = orders.join(building, "o_custkey", "left_anti")
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    yes = rest.join(back, "o_orderkey", "left_semi").withColumn("returned", F.lit(True))
    return yes.unionByName(rest.join(back, "o_orderkey", "left_anti").withColumn("returned", F.lit(False)))


# Canonical ids

# How sources spell models.
_SPELLED = (
    "gpt-5", "~openai/gpt-5", " ~ ~Claude-Sonnet-4-5 ", "glm-5.2", "moonshotai/kimi-k3", "openrouter/deepseek/deepseek-v4", "o3-mini", "grok-code-fast", "muse", "muse_x", "musette",
    "llama-3.3-70b", "my-model", "acme/my-model", "gemini-2.5-pro", "minimax-m3", ""
)
# Each event spells a model; every third puts a release of its user behind it.
_RAW = f"""{FACTS_SQL}, raw AS (SELECT [{", ".join(f"'{s}'" for s in _SPELLED)}][CAST(k % {len(_SPELLED)} AS BIGINT) + 1] || CASE WHEN k % 3 = 0 THEN '-r' || logical_session_id ELSE '' END AS x FROM facts),
spelled AS (SELECT x, count(*) AS n FROM raw GROUP BY x)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings of all events and how often each comes."""
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.element_at(F.array(*map(F.lit, _SPELLED)), (k % len(_SPELLED) + 1).cast("int"))
    release = F.when(k % 3 == 0, F.concat(F.lit("-r"), F.col("user_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "events").groupBy(F.concat(name, release).alias("x")).agg(F.count("*").alias("n"))


@query(f"{FACTS_SQL} SELECT raw_provider_id, {sql_provider('raw_provider_id')} AS provider, count(*) AS n FROM facts GROUP BY 1, 2")
def c1_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("raw_provider_id", canonical.canonical_provider("raw_provider_id").alias("provider")).agg(F.count("*").alias("n"))


@query(rf"{_RAW} SELECT x, n, trim(regexp_replace(x, '^\s*(~\s*)*', '')) AS routed FROM spelled")
def c2_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("x", "n", canonical.routed_model("x").alias("routed"))


@query(f"{_RAW} SELECT x, n, {sql_owner('x')} AS owner FROM spelled")
def c3_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("x", "n", canonical.model_owner("x").alias("owner"))


@query(f"{_RAW} SELECT x, n, {sql_model('x')} AS model, {sql_model(sql_model('x'))} AS again FROM spelled")
def c4_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = canonical.canonical_model("x")
    return _raw(spark, sf_dir).select("x", "n", once.alias("model"), canonical.canonical_model(once).alias("again"))


RULES = Config(
    overrides=(
        Override("view", "Acme", raw_provider="OPENAI", since="2024-01-10", until="2024-01-15"),
        Override("view", "late", raw_provider="openai", since="2024-01-12"),
        Override("click", "byModel", raw_model="glm-5.2"),
    ),
    model_aliases=(ModelAlias("gpt-5", "GPT-Five", owner="OpenAI"), ModelAlias("glm-5.2", "glm-five", provider="zai"), ModelAlias("kimi-k3", "never")),
)


@query(f"""{FACTS_SQL}, chosen AS (SELECT *, CASE
    WHEN harness = 'view' AND lower(coalesce(raw_provider_id, '')) = 'openai' AND occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-15' THEN 'acme'
    WHEN harness = 'view' AND lower(coalesce(raw_provider_id, '')) = 'openai' AND occurred_at >= TIMESTAMP '2024-01-12' THEN 'late'
    WHEN harness = 'click' AND lower(coalesce(raw_model_id, '')) = 'glm-5.2' THEN 'bymodel' END AS o,
    {sql_provider("raw_provider_id")} AS own, {sql_owner("raw_model_id")} AS owner FROM facts
), final AS (SELECT *, coalesce(o, own, owner) AS provider, CASE WHEN o IS NOT NULL THEN 'user-override' WHEN own IS NOT NULL AND own <> lower(raw_provider_id) THEN 'seed-alias'
    WHEN own IS NOT NULL THEN 'source' WHEN owner IS NOT NULL THEN 'model-owner' ELSE 'unknown' END AS resolution FROM chosen)
SELECT harness, provider, resolution, CASE WHEN raw_model_id = 'gpt-5' THEN 'openai/gpt-five' WHEN raw_model_id = 'glm-5.2' AND provider = 'zai' THEN 'glm-five' ELSE {sql_model("raw_model_id")} END AS model,
  count(*) AS n FROM final GROUP BY ALL""")
def c5_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = canonical.resolved(F.col("harness"), F.col("raw_provider_id"), F.col("raw_model_id"), F.col("occurred_at"), RULES)
    rows = facts(spark, sf_dir).select("harness", got["canonical_provider_id"].alias("provider"), got["provider_resolution"].alias("resolution"), got["canonical_model_id"].alias("model"))
    return rows.groupBy("harness", "provider", "resolution", "model").agg(F.count("*").alias("n"))


@query(f"{FACTS_SQL} SELECT DISTINCT session_id, substr(sha256('session:' || session_id), 1, 16) AS hashed FROM facts")
def c7_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("session_id").distinct().select("session_id", canonical.hash_id("session", "session_id").alias("hashed"))


@query(f"""{_RAW} SELECT x, n, CASE WHEN {sql_model("x")} IS NULL THEN 'unknown' WHEN contains({sql_model("x")}, '/') AND starts_with(split_part({sql_model("x")}, '/', 2), split_part({sql_model("x")}, '/', 1) || '-')
  THEN substr({sql_model("x")}, instr({sql_model("x")}, '/') + 1) ELSE {sql_model("x")} END AS display FROM spelled""")
def c8_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.coalesce(canonical.canonical_model("x"), F.lit("unknown"))
    return _raw(spark, sf_dir).select("x", "n", canonical.pretty_model(merged, merged).alias("display"))


@query(f"""{FACTS_SQL}, labels(raw, display) AS (VALUES ('glm', 'GLM plan'), ('openai', 'OpenAI'), ('zai-coding-plan', 'Coding plan')),
pairs AS (SELECT p, raw_provider_id AS raw, count(*) AS n FROM facts WHERE canonical_provider_id IS NOT NULL GROUP BY 1, 2)
SELECT p AS provider, CASE WHEN p = 'unknown' THEN 'Unknown provider' ELSE coalesce(
    (SELECT display FROM pairs q JOIN labels l ON lower(q.raw) = l.raw WHERE q.p = pairs.p ORDER BY lower(q.raw) <> q.p, q.raw LIMIT 1), (SELECT display FROM labels WHERE raw = pairs.p), p) END AS display,
  CAST(sum(n) AS BIGINT) AS event_count FROM pairs GROUP BY p""")
def c9_provider_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.provider_dimension(facts(spark, sf_dir), BILLING).drop("raw_provider_id")


@query(f"""{FACTS_SQL} SELECT DISTINCT m AS model, CASE split_part(m, '/', 1) WHEN 'openai' THEN 'subscription' WHEN 'zai' THEN 'metered' ELSE 'unspecified' END AS billing_mode FROM facts""")
def c10_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select(usage.model()).distinct().select("model", canonical.billing_mode(canonical.owner_segment("model"), BILLING).alias("billing_mode"))


# The directory of an event, with either slash, or none.
_PATHS_SQL = r"CASE CAST(user_id % 4 AS BIGINT) WHEN 0 THEN '/srv/' || event_type || '/app' || user_id || '//' WHEN 1 THEN 'C:\Work\' || event_type || '\Tool ' || user_id WHEN 2 THEN '//' END"


@query(rf"""WITH p AS (SELECT {_PATHS_SQL} AS path, count(*) AS n FROM events GROUP BY 1) SELECT path, n, coalesce(list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x <> '')[-1], 'Unassigned') AS name FROM p""")
def c11_project_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("user_id") % 4, F.col("user_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("/srv/"), "event_type", F.lit("/app"), user, F.lit("//"))).when(kind == 1, F.concat(F.lit("C:\\Work\\"), "event_type", F.lit("\\Tool "), user)).when(kind == 2, "//")
    paths = table(spark, sf_dir, "events").groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    return paths.select("path", "n", canonical.project_name("path").alias("name"))


@query(f"""{FACTS_SQL} SELECT id, CAST(floor(cost_nano_usd / 1e9::DOUBLE * 1000000000 + 0.5) AS BIGINT) AS nano, {sql_ratio("output_tokens", "cache_write_input_tokens")} AS r,
  processed_input_tokens + output_tokens + unattributed_tokens AS processed FROM facts""")
def c12_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("id", to_nano(to_usd("cost_nano_usd")).alias("nano"), ratio("output_tokens", "cache_write_input_tokens").alias("r"), processed_of_parts().alias("processed"))


# Aggregates


@query(sql_summary())
def a1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(facts(spark, sf_dir))


@query(f"""{FACTS_SQL} SELECT harness, p AS provider, CAST(sum(processed_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_input_tokens) AS BIGINT) AS read_tokens FROM facts
  GROUP BY 1, 2 HAVING sum(processed_input_tokens) > 0""")
def a2_harness_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = facts(spark, sf_dir).groupBy("harness", usage.provider()).agg(F.sum("processed_input_tokens").alias("input_tokens"), F.sum("cache_read_input_tokens").alias("read_tokens"))
    return agg.where("input_tokens > 0")


@query(f"""{FACTS_SQL} SELECT m AS model, max(raw_model_id) AS raw_model_id, CAST(sum(processed_tokens) AS BIGINT) AS processed_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS n FROM facts GROUP BY 1""")
def a3_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(usage.model()).agg(F.max("raw_model_id").alias("raw_model_id"), F.sum("processed_tokens").alias("processed_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n"))


@query(f"{FACTS_SQL} SELECT m AS model, count(DISTINCT session_id) AS sessions FROM facts GROUP BY 1")
def a4_model_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select(usage.model(), "session_id").groupBy("model").agg(F.countDistinct("session_id").alias("sessions"))


@query(f"{FACTS_SQL} SELECT min(occurred_at) AS first FROM facts WHERE harness = 'purchase'")
def a11_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(facts(spark, sf_dir), Filters(harness=("purchase",))).agg(F.min("occurred_at").alias("first"))


@query(f"""{FACTS_SQL} SELECT strftime(timezone('Europe/Berlin', timezone('UTC', occurred_at)), '%Y-%m-%d') AS date, m AS series, CAST(sum(processed_input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(cache_read_input_tokens) AS BIGINT) AS read_tokens FROM facts GROUP BY 1, 2""")
def a12_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = usage.local_day("Europe/Berlin").cast("string").alias("date")
    return facts(spark, sf_dir).groupBy(day, usage.model().alias("series")).agg(F.sum("processed_input_tokens").alias("input_tokens"), F.sum("cache_read_input_tokens").alias("read_tokens"))


@query(f"""{FACTS_SQL} SELECT 'provider' AS dimension, p AS value, count(*) AS n FROM facts GROUP BY 2 UNION ALL SELECT 'model', m, count(*) FROM facts GROUP BY 2
  UNION ALL SELECT 'harness', harness, count(*) FROM facts GROUP BY 2 UNION ALL SELECT 'project', project_id, count(*) FROM facts GROUP BY 2""")
def a13_dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select(usage.provider(), usage.model(), "harness", "project_id")
    # The four dimensions are counted together first: every later step works on few rows.
    cube = rows.groupBy("provider", "model", "harness", "project_id").count()
    names = {"provider": "provider", "model": "model", "harness": "harness", "project": "project_id"}
    long = cube.select("count", F.inline(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(v).alias("value")) for k, v in names.items()))))
    return long.groupBy("dimension", "value").agg(F.sum("count").alias("n"))


@query(f"{FACTS_SQL} SELECT count(*) AS total FROM facts WHERE {WHERE_JANUARY}")
def a16_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.count(facts(spark, sf_dir), JANUARY)


# Composite queries


@query(sql_summary(where=WHERE_JANUARY))
def q1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(facts(spark, sf_dir), JANUARY)


@query(sql_summary("harness AS harness"))
def q1_summary_by_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(facts(spark, sf_dir), by={"harness": F.col("harness")})


@query(sql_summary("p AS provider"))
def q1_summary_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(facts(spark, sf_dir), by={"provider": usage.provider()})


_DAY = "strftime(timezone('Europe/Berlin', timezone('UTC', occurred_at)), '%Y-%m-%d')"
_METRIC_SQL = {
    "processedTokens": "processed_tokens",
    "processedInputTokens": "processed_input_tokens",
    "outputTokens": "output_tokens",
    "freshInputTokens": "fresh_input_tokens",
    "cacheReadInputTokens": "cache_read_input_tokens",
    "costUsd": "CASE WHEN cost_available THEN cost_nano_usd ELSE 0 END",
    "requests": "1",
}


def sql_series(metric: str, by: str) -> str:
    column = {"provider": "p", "model": "m", "harness": "harness"}[by]
    spine = f"""spine AS (SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(min(CAST({_DAY} AS DATE)), max(CAST({_DAY} AS DATE)), INTERVAL 1 DAY)) AS d FROM facts))"""
    if metric == "cacheHitRate":
        points = f"SELECT {_DAY} AS date, {column} AS series, CAST(sum(cache_read_input_tokens) AS DOUBLE) / CAST(sum(processed_input_tokens) AS DOUBLE) AS value, CAST(sum(processed_input_tokens) AS BIGINT) AS input_tokens FROM facts GROUP BY 1, 2 HAVING sum(processed_input_tokens) > 0"
    else:
        value = _METRIC_SQL[metric]
        points = f"SELECT {_DAY} AS date, {column} AS series, CAST(sum({value}) AS DOUBLE) AS value, CAST(sum(processed_input_tokens) AS BIGINT) AS input_tokens FROM facts GROUP BY 1, 2 HAVING sum({value}) > 0"
    usd = "value / 1e9::DOUBLE" if metric == "costUsd" else "CAST(NULL AS DOUBLE)"
    return f"{FACTS_SQL}, {spine}, points AS ({points}) SELECT date, series, value, input_tokens, {usd} AS value_usd FROM spine LEFT JOIN points USING (date)"


def _series(metric: str, by: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return usage.timeseries(facts(spark, sf_dir), metric, by)

    run.__name__ = f"q2_series_{by}_{metric}"
    query(sql_series(metric, by))(run)


for _m in METRICS:
    _series(_m, "provider")
for _by in ("model", "harness"):
    for _m in ("processedTokens", "cacheHitRate"):
        _series(_m, _by)


@query(f"""{FACTS_SQL}, sums AS (SELECT m, max(raw_model_id) AS raw_model_id, CAST(sum(processed_tokens) AS BIGINT) AS processed_tokens, CAST(sum(processed_input_tokens) AS BIGINT) AS processed_input_tokens,
  CAST(sum(fresh_input_tokens) AS BIGINT) AS fresh_input_tokens, CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  sum(CASE WHEN cost_available THEN cost_nano_usd ELSE 0 END) AS nano, sum(CASE WHEN cost_available THEN processed_tokens ELSE 0 END) AS costed, count(DISTINCT session_id) AS sessions FROM facts GROUP BY m HAVING sum(processed_tokens) > 0)
SELECT m AS model, raw_model_id, CASE WHEN contains(m, '/') AND starts_with(split_part(m, '/', 2), split_part(m, '/', 1) || '-') THEN split_part(m, '/', 2) ELSE m END AS display, {sql_owner("m")} AS owner,
  processed_tokens, processed_input_tokens, fresh_input_tokens, cache_read_input_tokens, output_tokens, CASE WHEN costed > 0 THEN CAST(nano AS DOUBLE) / 1e9::DOUBLE END AS cost_usd,
  {sql_ratio("costed", "processed_tokens")} AS cost_coverage, CASE split_part(m, '/', 1) WHEN 'openai' THEN 'subscription' WHEN 'zai' THEN 'metered' ELSE 'unspecified' END AS billing_mode,
  sessions, {sql_ratio("cache_read_input_tokens", "processed_input_tokens")} AS cache_hit_rate FROM sums""")
def q3_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.models(facts(spark, sf_dir), config=BILLING)


_SMALL = {"min_input": 100_000, "max_ratio": 3}
_CELLS = f"""{FACTS_SQL}, cells AS (SELECT harness, p AS provider, CAST(sum(processed_input_tokens) AS BIGINT) AS i, CAST(sum(cache_read_input_tokens) AS BIGINT) AS r FROM facts GROUP BY 1, 2 HAVING sum(processed_input_tokens) > 0),
peers AS (SELECT a.harness, a.provider, CAST(coalesce(sum(b.i), 0) AS BIGINT) AS pi, CAST(coalesce(sum(b.r), 0) AS BIGINT) AS pr, count(b.harness) AS n FROM cells a LEFT JOIN cells b
  ON a.provider = b.provider AND a.harness <> b.harness AND a.provider <> 'unknown' AND a.i >= 100000 AND b.i >= 100000 AND greatest(a.i, b.i) <= 3 * least(a.i, b.i) GROUP BY 1, 2),
noted AS (SELECT c.*, pi, pr, CAST(i AS DOUBLE) / CAST(sum(i) OVER (PARTITION BY c.harness) AS DOUBLE) AS share, n FROM cells c JOIN peers USING (harness, provider)),
cellrows AS (SELECT *, CASE WHEN provider = 'unknown' THEN 'provider is unknown' WHEN share < 0.05 THEN 'below 5% of harness input' WHEN i < 100000 THEN 'less than 1M input tokens'
  WHEN n = 0 THEN 'no peer with at least 1M input and a 20×-balanced sample' END AS note FROM noted),
rated AS (SELECT *, CASE WHEN note IS NULL AND pi > 0 THEN CAST(pr AS DOUBLE) / CAST(pi AS DOUBLE) END AS other FROM cellrows)"""


@query(f"""{_CELLS} SELECT harness, provider, i AS processed_input_tokens, r AS cache_read_input_tokens, CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS observed_rate, share AS input_share, other AS other_harness_rate,
  pi AS comparator_input_tokens, note AS comparison_note, CAST(r AS DOUBLE) / CAST(i AS DOUBLE) - other AS lift FROM rated""")
def q4_attribution_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.attribution_cells(facts(spark, sf_dir), **_SMALL)


@query(f"""{_CELLS}, h AS (SELECT harness, CAST(sum(i) AS BIGINT) AS i, CAST(sum(r) AS BIGINT) AS r, sum(CASE WHEN other IS NOT NULL THEN i END) AS ci, sum(CASE WHEN other IS NOT NULL THEN r END) AS cr, sum(i * other) AS e FROM rated GROUP BY 1)
SELECT harness, i AS processed_input_tokens, r AS cache_read_input_tokens, round(CAST(r AS DOUBLE) / i, 9) AS observed_rate, round(CAST(cr AS DOUBLE) / ci, 9) AS comparable_observed_rate, round(e / ci, 9) AS provider_expected_rate,
  round(CAST(coalesce(ci, 0) AS DOUBLE) / i, 9) AS comparison_coverage, round(CAST(cr AS DOUBLE) / ci - e / ci, 9) AS adjusted_lift FROM h""")
def q4_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.attribution(usage.attribution_cells(facts(spark, sf_dir), **_SMALL))
    # The expected rate is a sum of doubles, whose order is free.
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


@query(f"""{FACTS_SQL} SELECT a.provider, a.harness AS harness, count(*) AS peers, CAST(sum(b.i) AS BIGINT) AS peer_input FROM (SELECT harness, p AS provider, sum(processed_input_tokens) AS i FROM facts GROUP BY 1, 2) a
  JOIN (SELECT harness, p AS provider, sum(processed_input_tokens) AS i FROM facts GROUP BY 1, 2) b ON a.provider = b.provider AND a.harness <> b.harness AND greatest(a.i, b.i) <= 2 * least(a.i, b.i) GROUP BY 1, 2""")
def j6_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = facts(spark, sf_dir).groupBy("harness", usage.provider()).agg(F.sum("processed_input_tokens").alias("i"))
    a, b = cells.alias("a"), cells.alias("b")
    met = a.join(b, (F.col("a.provider") == F.col("b.provider")) & (F.col("a.harness") != F.col("b.harness")) & (F.greatest("a.i", "b.i") <= 2 * F.least("a.i", "b.i")))
    return met.groupBy(F.col("a.provider").alias("provider"), F.col("a.harness").alias("harness")).agg(F.count("*").alias("peers"), F.sum("b.i").alias("peer_input"))


def sql_page(key: str, order: str, where: str = "TRUE", n: int = 11) -> str:
    return f"""{FACTS_SQL} SELECT id, harness, occurred_at, processed_tokens, {sql_model("canonical_model_id")} AS canonical_model_id FROM (SELECT *, {key} AS s FROM facts) WHERE {where}
  ORDER BY s {order} NULLS LAST, id {order} LIMIT {n}"""


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("id", "harness", "occurred_at", "processed_tokens", "canonical_model_id")


_PARTS = "(processed_input_tokens + output_tokens + unattributed_tokens)"
_COST = "(CASE WHEN cost_available THEN cost_nano_usd END)"
_NAME = "coalesce(canonical_model_id, raw_model_id, 'Unknown')"
_PAGES = {
    "oldest": ("occurred_at", "ASC"),
    "recent": ("occurred_at", "DESC"),
    "largest": (_PARTS, "DESC"),
    "model": (f"lower(substr({_NAME}, instr({_NAME}, '/') + 1))", "ASC"),
    "fresh": ("fresh_input_tokens", "DESC"),
    "cache": ("cache_read_input_tokens", "DESC"),
    "output": ("output_tokens", "DESC"),
    "cost": (_COST, "DESC"),
}


def _pages(sort: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _page(single.page(facts(spark, sf_dir), size=10, sort=sort))

    run.__name__ = f"q5_events_{sort}"
    query(sql_page(*_PAGES[sort]))(run)


for _s in _PAGES:
    _pages(_s)


@query(sql_page(_PARTS, "DESC", f"{WHERE_JANUARY} AND (s < 9000 OR (s = 9000 AND id < '5'))", 251))
def o1_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(single.page(facts(spark, sf_dir), JANUARY, single.encode_cursor(9000, "5"), 1000, "largest"))


@query(sql_page(_COST, "ASC", "(s IS NULL OR s > 1000000000 OR (s = 1000000000 AND id > '5'))", 101))
def o2_cost_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(single.page(facts(spark, sf_dir), cursor=single.encode_cursor(1_000_000_000, "5"), sort="cost", order="asc"))


@query(sql_page(_COST, "DESC", "s IS NULL AND id < '7'", 101))
def o2_cost_null_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(single.page(facts(spark, sf_dir), cursor=single.encode_cursor(None, "7"), sort="cost"))


@query(f"{FACTS_SQL} SELECT id, lower(substr({_NAME}, instr({_NAME}, '/') + 1)) AS sort_value FROM facts")
def o3_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("id", single.sort_key("model").alias("sort_value"))


@query(sql_page("occurred_at", "ASC", "session_id = 'view:3'"))
def q10_session_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(single.page(facts(spark, sf_dir), Filters(session="view:3"), size=10))


# Dimensions and joins


@query(f"""{FACTS_SQL} SELECT m AS model, CASE WHEN contains(m, '/') AND starts_with(split_part(m, '/', 2), split_part(m, '/', 1) || '-') THEN split_part(m, '/', 2) ELSE m END AS display, {sql_owner("m")} AS owner,
  count(*) AS event_count, CAST(sum(processed_tokens) AS BIGINT) AS total_tokens FROM facts WHERE canonical_model_id IS NOT NULL GROUP BY m""")
def q7_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.model_dimension(facts(spark, sf_dir))


@query(f"""{FACTS_SQL} SELECT DISTINCT harness FROM facts""")
def q7_harnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.harness_dimension(facts(spark, sf_dir))


@query(f"""{FACTS_SQL} SELECT p.project_id, p.display_path AS path, count(f.id) AS event_count FROM projects p LEFT JOIN facts f USING (project_id) GROUP BY 1, 2""")
def q7_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.project_dimension(facts(spark, sf_dir), projects(spark))


@query(f"""{FACTS_SQL} SELECT f.id, f.project_id, p.display_path FROM facts f LEFT JOIN projects p USING (project_id)""")
def j1_project_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).join(projects(spark), "project_id", "left").select("id", "project_id", "display_path")


_KNOWN = ("gpt-5", "openai/gpt-5", "zai/glm-5.2", "acme/none", "google/gemini-9")


@query(f"""{FACTS_SQL}, known(id) AS (VALUES {", ".join(f"('{k}')" for k in _KNOWN)}) SELECT CASE {sql_owner("known.id")} WHEN 'openai' THEN 'openai/gpt-5' ELSE known.id END AS model,
  count(f.id) AS event_count, CAST(coalesce(sum(processed_tokens), 0) AS BIGINT) AS total_tokens FROM known LEFT JOIN facts f ON f.canonical_model_id = known.id GROUP BY 1""")
def j2_models_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k,) for k in _KNOWN], "model_id string")
    return usage.model_dimension(facts(spark, sf_dir), known).select("model", "event_count", "total_tokens")


@query(f"""{FACTS_SQL} SELECT p.project_id, count(f.id) AS event_count, count(DISTINCT f.session_id) AS sessions FROM projects p LEFT JOIN facts f ON f.project_id = p.project_id AND f.harness = 'purchase' GROUP BY 1""")
def j3_projects_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply(facts(spark, sf_dir), Filters(harness=("purchase",))).groupBy("project_id").agg(F.count("*").alias("event_count"), F.countDistinct("session_id").alias("sessions"))
    return projects(spark).join(rows, "project_id", "left").select("project_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("event_count", "sessions")))


@query(f"""{FACTS_SQL}, rules(i, harness, provider, a, b) AS (VALUES (0, 'view', 'openai', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10'), (1, 'view', NULL, TIMESTAMP '2024-01-08', NULL), (2, 'purchase', NULL, NULL, TIMESTAMP '2024-01-15'))
SELECT f.id, min(i) AS rule FROM facts f JOIN rules r ON r.harness = f.harness AND (r.provider IS NULL OR r.provider = lower(f.raw_provider_id)) AND (a IS NULL OR occurred_at >= a) AND (b IS NULL OR occurred_at < b) GROUP BY 1""")
def j8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "view", "openai", "2024-01-05", "2024-01-10"), (1, "view", None, "2024-01-08", None), (2, "purchase", None, None, "2024-01-15")]
    rules = spark.createDataFrame(rows, "i int, harness string, provider string, a string, b string")
    rules = rules.withColumns({c: F.col(c).cast("timestamp_ntz") for c in "ab"})
    met = facts(spark, sf_dir).join(F.broadcast(rules), "harness")
    fits = (F.col("provider").isNull() | (F.col("provider") == F.lower("raw_provider_id"))) & (F.col("a").isNull() | (F.col("occurred_at") >= F.col("a"))) & (F.col("b").isNull() | (F.col("occurred_at") < F.col("b")))
    return met.where(fits).groupBy("id").agg(F.min("i").alias("rule"))


@query(f"""{FACTS_SQL}, meta(m, label) AS (VALUES ('openai/gpt-5', 'GPT'), ('zai/glm-5.2', 'GLM')) SELECT f.m AS model, coalesce(label, f.m) AS label, count(*) AS n FROM facts f LEFT JOIN meta USING (m) GROUP BY 1, 2""")
def j9_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([("openai/gpt-5", "GPT"), ("zai/glm-5.2", "GLM")], "model string, label string")
    counts = facts(spark, sf_dir).groupBy(usage.model()).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(meta), "model", "left").select("model", F.coalesce("label", "model").alias("label"), "n")


@query(f"{FACTS_SQL} SELECT session_id FROM facts WHERE p = 'zai' UNION SELECT session_id FROM facts WHERE cost_available")
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    zai = apply(rows, Filters(provider=("zai",))).select("session_id")
    return zai.union(rows.where("cost_available").select("session_id")).distinct()


@query(f"{FACTS_SQL} SELECT DISTINCT raw_provider_id, canonical_provider_id FROM facts")
def u2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("raw_provider_id", "canonical_provider_id").distinct()


@query(f"""{FACTS_SQL}, s AS (SELECT harness, m, CAST(sum(processed_tokens) AS BIGINT) AS t FROM facts GROUP BY 1, 2) SELECT harness, m AS model, t AS processed_tokens, CAST(t AS DOUBLE) / CAST(sum(t) OVER (PARTITION BY harness) AS DOUBLE) AS share FROM s""")
def w7_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = facts(spark, sf_dir).groupBy("harness", usage.model()).agg(total("processed_tokens").alias("processed_tokens"))
    return sums.withColumn("share", ratio("processed_tokens", F.sum("processed_tokens").over(Window.partitionBy("harness"))))


@query(f"""{FACTS_SQL}, s AS (SELECT m AS model, CAST(sum(CASE WHEN cost_available THEN cost_nano_usd END) AS BIGINT) AS cost_nano, CAST(sum(processed_tokens) AS BIGINT) AS t, count(*) AS n FROM facts GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY t DESC, n DESC, model) AS BIGINT) AS place, model, t AS total_tokens, cost_nano FROM s""")
def o9_ordered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = facts(spark, sf_dir).groupBy(usage.model()).agg(F.sum(costed()).alias("cost_nano"), F.sum("processed_tokens").alias("total_tokens"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total_tokens"), F.desc("n"), "model"))
    return sums.select(place.cast("long").alias("place"), "model", "total_tokens", "cost_nano")
