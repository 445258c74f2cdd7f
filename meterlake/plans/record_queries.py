"""Readers, guard, identity and flags on logs made from the events table: each row of it is one line of a log."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import graph, normalize, reports, store
from meterlake.plans.facts import FACTS_SQL, facts, table
from meterlake.plans.registry import query
from meterlake.session import written
from meterlake.sources.claude import claude
from meterlake.sources.pi import pi

cursor, opencode = (importlib.import_module(f"meterlake.sources.{name}") for name in ("cursor", "opencode"))

_BASE = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS file, event_id AS ordinal, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("ordinal"), "ts", "event_type", k, cents)
    # A file of the table is few tasks; a row of it becomes a long line.
    return rows.repartition("file")


def _json(**fields: Column | str) -> Column:
    """A JSON object of these fields; nulls are left out."""
    return F.to_json(F.struct(*((F.expr(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items())))


def _log(lines: DataFrame) -> DataFrame:
    """Lines as a reader meets them: written, not made anew for each expression that looks at them."""
    return written(lines, "log")


_PREVIOUS = "cast(lag(ordinal) OVER (PARTITION BY file ORDER BY ordinal) AS string)"


@query(f"""{_BASE}, v AS (SELECT *, CASE WHEN k % 4 > 0 THEN 2 * k ELSE 0 END AS r, CASE WHEN k % 5 > 0 THEN greatest(0, k % 7 - 1) ELSE 0 END AS w FROM e)
SELECT 's' || file || ':' || ordinal AS request_id, 's' || file AS logical_session_id, k AS fresh_input_tokens, r AS cache_read_input_tokens, w AS cache_write_input_tokens, k % 5 > 0 AS cache_write_available,
  k % 50 AS output_tokens, CASE WHEN k % 2 = 0 THEN k % 9 END AS reasoning_output_tokens, greatest(0, 5 * k - k - r - w - k % 50) AS unattributed_tokens, cents * 10000000 AS cost_nano_usd, ts AS occurred_at,
  CAST(last_value(CASE WHEN k % 4 = 0 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS turn_id FROM v""")
def n1_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of messages per user, each with usage whose fields have one of their spellings."""
    third = lambda n, kind: f"CASE WHEN k % 3 = {n} THEN cast(k AS {kind}) END"
    usage = F.struct(
        F.expr(third(0, "bigint")).alias("input"),
        F.expr(third(1, "bigint")).alias("inputTokens"),
        F.expr(third(2, "string")).alias("input_tokens"),
        F.expr("CASE WHEN k % 4 > 0 THEN 2 * k END").alias("cachedInput"),
        F.expr("CASE WHEN k % 5 > 0 THEN k % 7 - 1 END").alias("cache_write"),
        F.expr("k % 50").alias("output"),
        F.expr("CASE WHEN k % 2 = 0 THEN k % 9 END").alias("reasoningTokens"),
        F.expr("5 * k").alias("total_tokens"),
        F.expr("cast(cents / 100 AS decimal(20, 2))").alias("cost_total"),
    )
    text = _json(id="cast(ordinal AS string)", parent_id=_PREVIOUS, session_id="concat('s', file)", role="CASE WHEN k % 4 = 0 THEN 'User' ELSE 'assistant' END", usage=usage, createdAt="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")")
    got = pi(_log(_events(spark, sf_dir).select("file", "ordinal", text.alias("text"))))
    names = "request_id logical_session_id fresh_input_tokens cache_read_input_tokens cache_write_input_tokens cache_write_available output_tokens reasoning_output_tokens unattributed_tokens cost_nano_usd occurred_at turn_id"
    return got.select(*names.split())


@query(f"""{_BASE}, v AS (SELECT *, k % 10 AS m, k // 50 AS i, k // 100 AS r, CASE WHEN k % 3 = 0 THEN k // 200 ELSE k % 2 + k // 500 END AS w, CASE WHEN k % 13 = 0 THEN NULL ELSE cents // 100000 END AS o FROM e),
l AS (SELECT *, last_value(CASE WHEN o IS NOT NULL THEN [i, r, w, o] END IGNORE NULLS) OVER (PARTITION BY file, m ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT file, ordinal, CASE WHEN o IS NULL THEN 'quarantine' WHEN [i, r, w, o] = p THEN 'duplicate' WHEN i + r + w + o = 0 THEN 'skipped' ELSE 'usage' END AS kind, CASE WHEN o IS NULL THEN 'invalid-token-count' END AS reason,
  'm' || m || ':q' AS request_id, w AS cache_write_input_tokens, CASE WHEN k % 7 = 0 THEN 'subagent' ELSE 'main' END AS query_source, 'f' || file AS logical_session_id FROM l""")
def n8_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of responses: classes, duplicates of the last valid one, quarantine, sides."""
    usage = F.struct(
        F.expr("k div 50").alias("input_tokens"),
        F.expr("k div 100").alias("cache_read_input_tokens"),
        F.expr("CASE WHEN k % 3 = 0 THEN k div 200 END").alias("cache_creation_input_tokens"),
        F.struct(F.expr("k % 2").alias("ephemeral_5m_input_tokens"), F.expr("k div 500").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
        F.expr("CASE WHEN k % 13 = 0 THEN -1 ELSE cents div 100000 END").alias("output_tokens"),
    )
    message = F.struct(F.expr("concat('m', k % 10)").alias("id"), usage.alias("usage"))
    text = _json(type="'assistant'", uuid="cast(ordinal AS string)", request_id="'q'", isSidechain="CASE WHEN k % 7 = 0 THEN true END", message=message)
    lines = _events(spark, sf_dir).select(F.concat(F.lit("/p/f"), F.col("file"), F.lit(".jsonl")).alias("file"), "ordinal", text.alias("text"))
    got = claude(_log(lines)).select(F.regexp_extract("file", "f([0-9]+)", 1).alias("file"), "ordinal", "kind", "reason", "request_id", "cache_write_input_tokens", "query_source", "logical_session_id")
    return got


_TOKENS = """CASE WHEN k % 11 = 0 THEN 0 ELSE k % 100 END AS i, CASE WHEN k % 11 = 0 THEN 0 ELSE k % 30 END AS o, CASE WHEN k % 3 = 0 AND k % 11 > 0 THEN k % 4 END AS rs, CASE WHEN k % 2 = 0 AND k % 11 > 0 THEN k % 20 END AS rd, CASE WHEN k % 5 > 0 AND k % 11 > 0 THEN k % 6 END AS w, CASE WHEN k % 17 = 0 THEN -1 WHEN k % 7 = 0 AND k % 11 > 0 THEN k END AS t"""


def _messages(spark: SparkSession, sf_dir: str, id_: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("*", *("CASE" + x if n else x for n, x in enumerate(_TOKENS.split(", CASE"))), f"{_PREVIOUS} AS previous")
    cache = F.struct(F.col("rd").alias("read"), F.col("w").alias("write"))
    tokens = F.struct(F.col("i").alias("input"), F.col("o").alias("output"), F.col("rs").alias("reasoning"), cache.alias("cache"), F.col("t").alias("total"))
    time = F.struct(F.expr("CASE WHEN k % 2 = 0 THEN 1700000000000 + k * 1000 END").alias("created"))
    data = _json(role="CASE WHEN k % 4 = 0 THEN 'user' ELSE 'assistant' END", parentID="previous", providerID="concat('p', k % 3)", modelID="concat('m', k div 250)", cost="CASE WHEN k % 9 = 0 THEN -1D ELSE k / 4D END", path=F.struct(F.expr("CASE WHEN k % 5 = 0 THEN '/own' END").alias("cwd")), tokens=tokens, time=time)
    return rows.select(
        F.col("ordinal").alias("rowid"), F.expr(id_).alias("id"), F.concat(F.lit("s"), "file").alias("session_id"), F.expr("1600000000000 + ordinal * 1000").alias("time_created"), F.col("ordinal").alias("time_updated"),
        data.alias("data"), F.lit("/dir").alias("session_directory"), F.when(F.col("file").cast("long") % 3 == 0, "top").alias("session_parent_id"), F.col("ordinal").alias("delivery"),
    )


@query(f"""{_BASE}, v AS (SELECT *, {_TOKENS} FROM e), n AS (SELECT *, coalesce(rd, 0) AS read_, coalesce(w, 0) AS write_, o + coalesce(rs, 0) AS out_, CASE WHEN t IS NULL THEN 0 ELSE greatest(0, t - i - coalesce(rd, 0) - coalesce(w, 0) - o - coalesce(rs, 0)) END AS u FROM v WHERE k % 4 <> 0)
SELECT CAST(ordinal AS VARCHAR) AS request_id, CASE WHEN t < 0 THEN 'quarantine' WHEN i + read_ + write_ + out_ + u = 0 THEN 'skipped' ELSE 'usage' END AS kind, CASE WHEN t < 0 THEN 'invalid-token-count' END AS reason, i AS fresh_input_tokens,
  read_ AS cache_read_input_tokens, write_ AS cache_write_input_tokens, w IS NOT NULL AS cache_write_available, out_ AS output_tokens, rs AS reasoning_output_tokens,
  CASE WHEN k % 9 = 0 THEN NULL ELSE k * 250000000 END AS cost_nano_usd, CASE WHEN t < 0 THEN 0 ELSE u END AS unattributed_tokens FROM n""")
def n12_opencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = opencode.opencode(_log(_messages(spark, sf_dir, "cast(ordinal AS string)")))
    return got.select("request_id", "kind", "reason", "fresh_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "cache_write_available", "output_tokens", "reasoning_output_tokens", "cost_nano_usd", F.when(F.col("kind") == "quarantine", F.lit(0)).otherwise(F.col("unattributed_tokens")).cast("long").alias("unattributed_tokens"))


@query(f"""{_BASE}, a AS (SELECT *, CAST(last_value(CASE WHEN k % 4 = 0 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS turn FROM e)
SELECT CAST(ordinal AS VARCHAR) AS request_id, 's' || file AS logical_session_id, ordinal, CASE WHEN k % 5 = 0 THEN '/own' ELSE '/dir' END AS cwd, CASE WHEN CAST(file AS BIGINT) % 3 = 0 THEN 'subagent' ELSE 'main' END AS query_source, turn AS turn_id,
  epoch_ms(CASE WHEN k % 2 = 0 THEN 1700000000000 + k * 1000 ELSE 1600000000000 + ordinal * 1000 END) AS occurred_at FROM a WHERE k % 4 <> 0""")
def n13_opencode_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = opencode.opencode(_log(_messages(spark, sf_dir, "cast(ordinal AS string)")))
    return got.select("request_id", "logical_session_id", "ordinal", "cwd", "query_source", "turn_id", "occurred_at")


@query(f"""{_BASE}, v AS (SELECT file || '-' || k % 3 AS id, ordinal, k // 100 AS i, k // 300 AS c FROM e), l AS (SELECT *, last_value(CASE WHEN i > 0 THEN [i, c] END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT id AS request_id, ordinal, CASE WHEN i = 0 THEN 'skipped' WHEN [i, c] = p THEN 'duplicate' ELSE 'usage' END AS kind FROM l""")
def n14_opencode_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of messages: one that changes no count and no cost is a duplicate."""
    data = _json(role="'assistant'", cost="(k div 300) / 2D", finish="cast(k AS string)", tokens=F.struct(F.expr("k div 100").alias("input")))
    rows = _events(spark, sf_dir).select(
        F.col("ordinal").alias("rowid"), F.expr("concat_ws('-', file, k % 3)").alias("id"), F.lit("s").alias("session_id"), F.lit(1).cast("long").alias("time_created"), F.col("ordinal").alias("time_updated"),
        data.alias("data"), F.lit(None).cast("string").alias("session_directory"), F.lit(None).cast("string").alias("session_parent_id"), F.col("ordinal").alias("delivery"),
    )
    return opencode.opencode(_log(rows)).select("request_id", "ordinal", "kind")


@query(f"""{_BASE}, v AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'unknown-schema' WHEN k % 17 = 0 THEN 'invalid-token-value' WHEN k % 13 = 0 THEN 'malformed-json' WHEN k % 7 = 0 THEN 'cursor-token-fields-missing' END AS reason, k % 3 = 0 AS legacy FROM e)
SELECT file, ordinal, CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN k % 50 = 0 THEN 'skipped' ELSE 'usage' END AS kind, reason,
  list_filter([CASE WHEN k % 6 = 0 THEN 'multi-root-project-ambiguous' END, CASE WHEN NOT legacy THEN 'cursor-input-semantics-unverified' END, CASE WHEN legacy THEN 'historical-partial-accounting' END,
    CASE WHEN legacy AND k % 4 <> 0 THEN 'approximate-timestamp' END, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'missing-cache-read' END], lambda x: x IS NOT NULL) AS flags FROM v""")
def n15_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation, quarantine and flags (N15, N16) of spooled events."""
    some = lambda x: f"CASE WHEN k % 7 <> 0 THEN {x} END"
    text = _json(
        schema="CASE WHEN k % 19 = 0 THEN 'v0' ELSE 'meterlake.cursor.usage.v1' END",
        source="CASE WHEN k % 3 = 0 THEN 'legacy-backfill' ELSE 'stop-hook' END",
        conversationId="file",
        generationId="CASE WHEN k % 13 = 0 THEN '' ELSE cast(ordinal AS string) END",
        inputTokens=some("CASE WHEN k % 17 = 0 THEN -1 ELSE k % 50 END"),
        outputTokens=some("0"),
        cacheReadTokens="CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN k % 50 END",
        reasoningTokens="CASE WHEN k % 17 = 0 THEN -1 END",
        timestampConfidence="CASE WHEN k % 4 = 0 THEN 'exact' ELSE 'approximate' END",
        flags="CASE WHEN k % 6 = 0 THEN array('multi-root-project-ambiguous', 'own') END",
    )
    got = cursor.cursor(_log(_events(spark, sf_dir).select("file", "ordinal", text.alias("text"))))
    return got.select("file", "ordinal", "kind", "reason", "flags")


def _bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.struct(F.expr("CASE WHEN k % 3 = 0 THEN 'default' ELSE concat('m', k % 3) END").alias("modelName"))
    counts = F.struct(F.expr("k").alias("inputTokens"), F.expr("cents div 1000").alias("outputTokens"))
    user = _json(type="1", modelInfo=model)
    own = _json(type="2", usageUuid="concat_ws('-', file, k % 5)", tokenCount=counts, timingInfo=F.struct(F.expr("CASE WHEN cast(file AS bigint) % 2 = 0 THEN ordinal END").alias("clientRpcSendTime")))
    rows = _events(spark, sf_dir)
    return _log(rows.select("file", "ordinal", F.format_string("bubbleId:%s:%012d", "file", "ordinal").alias("key"), F.when(F.col("k") % 4 == 0, user).otherwise(own).alias("value")))


@query(f"""{_BASE} SELECT file AS composer, ordinal, model FROM (SELECT *, last_value(CASE WHEN k % 4 = 0 AND k % 3 > 0 THEN 'm' || k % 3 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ordinal DESC ROWS UNBOUNDED PRECEDING) AS model FROM e) WHERE k % 4 <> 0 AND k + cents // 1000 > 0""")
def n17_cursor_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of requests by the order of the conversation, here from the latest event to the first."""
    rows = _bubbles(spark, sf_dir)
    order = F.transform(F.sort_array(F.collect_list("ordinal"), asc=False), lambda i: F.struct(F.lpad(i.cast("string"), 12, "0").alias("bubbleId")))
    composers = rows.groupBy("file").agg(F.to_json(F.struct(order.alias("fullConversationHeadersOnly"))).alias("value")).select(F.concat(F.lit("composerData:"), "file").alias("key"), "value")
    got = cursor.attributed(cursor.bubbles(rows), composers)
    return got.select("composer", F.col("bubble").cast("long").alias("ordinal"), "model")


@query(f"""{_BASE}, b AS (SELECT file || '-' || k % 5 AS usage_id, ordinal, k AS i, cents // 1000 AS o, CASE WHEN CAST(file AS BIGINT) % 2 = 0 THEN ordinal END AS t FROM e WHERE k % 4 <> 0 AND k + cents // 1000 > 0),
w AS (SELECT *, count(DISTINCT [i, o]) OVER (PARTITION BY usage_id) AS kinds, bool_and(t IS NOT NULL) OVER (PARTITION BY usage_id) AS timed, coalesce(i >= lag(i) OVER by_time AND o >= lag(o) OVER by_time, TRUE) AS a, coalesce(i >= lag(i) OVER by_size AND o >= lag(o) OVER by_size, TRUE) AS z
  FROM b WINDOW by_time AS (PARTITION BY usage_id ORDER BY t, ordinal), by_size AS (PARTITION BY usage_id ORDER BY i, o, ordinal)),
g AS (SELECT usage_id, kinds, timed, bool_and(a) AS in_time, bool_and(z) AS in_size, max(ordinal) AS last, arg_max(ordinal, [i, o, ordinal]) AS largest FROM w GROUP BY 1, 2, 3)
SELECT usage_id, CASE WHEN kinds = 1 OR timed THEN last ELSE largest END AS ordinal, kinds = 1 OR CASE WHEN timed THEN in_time ELSE in_size END AS kept FROM g""")
def n18_cursor_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = cursor.bubbles(_bubbles(spark, sf_dir)).where("NOT user")
    return cursor.resolved_duplicates(requests).select("usage_id", F.col("bubble").cast("long").alias("ordinal"), "kept")


@query(f"""{_BASE} SELECT file, ordinal, k % 6 IN (1, 3, 4) AS content FROM e""")
def n19_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts with an empty text, a text, a number, an object, a nested text, and a text that is quoted in another."""
    quoted = '\'{"note": "say \\\\"content\\\\": \\\\"x\\\\" \', \'", "input": 5}\''
    text = F.expr(f"""CASE k % 6 WHEN 0 THEN '{{"prompt": ""}}' WHEN 1 THEN concat('{{"Content": "c', k, '"}}') WHEN 2 THEN concat('{{"output": ', k, '}}') WHEN 3 THEN '{{"body": {{}}}}'
      WHEN 4 THEN concat('{{"a": [{{"b": "", "text": "', k, '"}}]}}') ELSE concat({quoted}) END""")
    return _events(spark, sf_dir).select("file", "ordinal", normalize.holds_content(text).alias("content"))


@query(f"""{_BASE} SELECT file, ordinal, substr(sha256('{{"k":' || k || ',"model":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '"m' || k % 4 || '"' END || ',"session":"' || file || '"}}'), 1, 32) AS envelope_hash FROM e""")
def n20_envelope_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumns({"session": F.col("file"), "model": F.expr("CASE WHEN k % 4 > 0 THEN concat('m', k % 4) END")})
    return rows.select("file", "ordinal", normalize.envelope_hash(rows, ["session", "model", "k"]).alias("envelope_hash"))


@query(f"""{_BASE} SELECT file, ordinal, list_filter([CASE WHEN k % 2 = 0 THEN 'missing-cache-write' END, CASE WHEN k % 3 = 0 THEN 'missing-reasoning' END, CASE WHEN k % 5 = 0 THEN 'missing-cost' END,
  CASE WHEN k % 4 < 3 THEN 'approximate-timestamp' END, CASE WHEN k % 4 = 1 THEN 'missing-cache-read' END], lambda x: x IS NOT NULL) AS quality_flags FROM e""")
def n23_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.expr("CASE k % 4 WHEN 0 THEN array('approximate-timestamp', 'made-up', 'approximate-timestamp') WHEN 1 THEN array('approximate-timestamp', 'missing-cache-read') WHEN 2 THEN array('approximate-timestamp', 'missing-cost-x') END")
    k = F.col("k")
    return _events(spark, sf_dir).select("file", "ordinal", normalize.quality_flags(k % 2 != 0, k % 3 != 0, k % 5 != 0, own).alias("quality_flags"))


@query(f"""{_BASE} SELECT event_type AS file, count(*) FILTER (WHERE k % 3 = 0) AS imported, count(*) FILTER (WHERE k % 3 = 1) AS duplicates, count(*) FILTER (WHERE k % 3 = 2) AS quarantined FROM e GROUP BY 1""")
def n22_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("file"), F.expr("element_at(array('usage', 'duplicate', 'quarantine'), cast(k % 3 + 1 AS int))").alias("kind"))
    return normalize.routed(rows)


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS VARCHAR) AS node, CASE WHEN turn > 1 THEN CAST(turn - 2 AS VARCHAR) END AS parent, role FROM conversations""")
def k4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are registered twice, the second time with another parent and without a role."""
    rows = table(spark, sf_dir, "conversations")
    node = [F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("node")]
    one = rows.select(*node, F.lit(None).cast("string").alias("parent"), "role", (2 * F.col("turn")).alias("ordinal"))
    two = rows.select(*node, F.when(F.col("turn") > 1, (F.col("turn") - 2).cast("string")).alias("parent"), F.lit(None).cast("string").alias("role"), (2 * F.col("turn") + 1).alias("ordinal"))
    return graph.merged_nodes(one.union(two)).drop("ordinal")


@query("""WITH RECURSIVE n AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS node, CASE turn % 7 WHEN 5 THEN turn + 1 WHEN 6 THEN turn - 1 WHEN 3 THEN -9 ELSE turn - 1 END AS parent, role FROM conversations),
walk(session, node, pos, hops) AS (SELECT session, node, parent, 0 FROM n UNION ALL SELECT w.session, w.node, n.parent, hops + 1 FROM walk w JOIN n ON n.session = w.session AND n.node = w.pos WHERE n.role <> 'user' AND hops < 40)
SELECT n.session, CAST(n.node AS VARCHAR) AS node, CAST(max(u.node) AS VARCHAR) AS ancestor FROM n LEFT JOIN walk w ON w.session = n.session AND w.node = n.node LEFT JOIN n u ON u.session = w.session AND u.node = w.pos AND u.role = 'user' GROUP BY 1, 2""")
def g2_from_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors from the parent on, in graphs with cycles and dead ends."""
    turn = F.col("turn")
    parent = F.expr("CASE turn % 7 WHEN 5 THEN turn + 1 WHEN 6 THEN turn - 1 WHEN 3 THEN -9 ELSE turn - 1 END").cast("string")
    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), turn.cast("string").alias("node"), parent.alias("parent"), "role")
    return graph.nearest(nodes, ("user",), from_parent=True).select("session", "node", "ancestor")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    status = F.when(F.lead("ordinal").over(Window.partitionBy("file").orderBy("ordinal")).isNotNull(), "running").otherwise("completed")
    return rows.select(
        F.col("file").alias("run_id"), F.col("ordinal").alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.lit(1).cast("long").alias("files"), F.col("k").alias("imported"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("duplicates"),
        F.lit(None).cast("long").alias("quarantined"), F.when(F.col("k") % 97 == 0, F.concat(F.lit("e"), F.col("k").cast("string"))).alias("error"),
    )


_RUNS = f"""{_BASE}, r AS (SELECT file AS run_id, min(ts) AS started_at, arg_max(ts, ordinal) AS finished_at, 'completed' AS status, count(*) AS files, CAST(sum(k) AS BIGINT) AS imported, CAST(coalesce(sum(CASE WHEN k % 2 = 0 THEN k END), 0) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS quarantined,
  string_agg(CASE WHEN k % 97 = 0 THEN 'e' || k END, '; ' ORDER BY ordinal) AS error FROM e GROUP BY 1)"""


@query(f"{_RUNS} SELECT * FROM r")
def k12_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_log(_runs(spark, sf_dir))


@query(f"{_RUNS} SELECT run_id, started_at FROM r ORDER BY started_at DESC, run_id DESC LIMIT 7")
def o10_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_runs(store.run_log(_runs(spark, sf_dir)), 7).select("run_id", "started_at")


@query(f"""{_RUNS} SELECT CAST((SELECT count(*) FROM e WHERE k % 5 = 0) + (SELECT count(*) FROM r WHERE error IS NOT NULL) AS BIGINT) AS warnings""")
def a14_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("k") % 5 == 0).alias("quarantined"))
    return store.warnings(sources, store.run_log(_runs(spark, sf_dir)))


@query(f"""{FACTS_SQL}, u AS (SELECT session_id, m AS model, p AS provider, CAST(sum(processed_tokens) AS BIGINT) AS processed_tokens, sum(CASE WHEN cost_available THEN cost_nano_usd END) / 1e9::DOUBLE AS cost_usd FROM facts GROUP BY 1, 2, 3)
SELECT session_id, model, provider, CAST(processed_tokens AS DOUBLE) / CAST(sum(processed_tokens) OVER (PARTITION BY session_id) AS DOUBLE) AS share, row_number() OVER (PARTITION BY session_id ORDER BY cost_usd DESC NULLS LAST, model, provider) AS place FROM u""")
def v13_model_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlake.functions.metrics import costed, to_usd
    from meterlake.operators import usage

    sums = facts(spark, sf_dir).groupBy("session_id", usage.model(), usage.provider()).agg(F.sum("processed_tokens").alias("processed_tokens"), F.sum(costed()).alias("nano"))
    return reports.model_shares(sums.withColumn("cost_usd", to_usd("nano")), "cost").select("session_id", "model", "provider", "share", "place")


@query(f"""{FACTS_SQL}, s AS (SELECT session_id, CAST(floor((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 60000000) AS BIGINT) AS m FROM facts GROUP BY 1)
SELECT session_id, CASE WHEN m < 1 THEN '<1m' WHEN m >= 1440 THEN (m // 1440) || 'd ' || (m % 1440 // 60) || 'h' WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS span FROM s""")
def v13_observed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = facts(spark, sf_dir).groupBy("session_id").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    return bounds.select("session_id", reports.span_text("first", "last").alias("span"))
