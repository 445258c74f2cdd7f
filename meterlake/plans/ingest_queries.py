"""The windows of ingestion and of the store, on counters made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import ingest, store
from meterlake.plans.facts import table
from meterlake.plans.registry import query

# One user's events in order; k is the number in props, cents the rounded value. Every 11th k repeats its predecessor's vector.
_BASE = """WITH e AS (SELECT user_id, event_id AS ordinal, ts AS occurred_at, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), F.col("ts").alias("occurred_at"), "event_type", k, cents)


@query(f"""{_BASE}, v AS (SELECT *, k // 20 * 100 AS i, k // 20 * 30 AS c, CASE WHEN k % 10 = 3 THEN NULL WHEN k % 10 = 4 THEN -1 ELSE k // 50 END AS w, k // 30 * 10 AS o, CASE WHEN k % 10 = 5 THEN 99 END AS r, k // 20 * 100 + k // 30 * 10 - CASE WHEN k % 10 = 6 THEN 5 ELSE 0 END AS t FROM e),
l AS (SELECT *, lag([i, c, w, o, r, t]) OVER (PARTITION BY user_id ORDER BY ordinal) AS p FROM v), n AS (SELECT *, CASE WHEN w < 0 OR t < 0 THEN 'negative-token-count' WHEN c + coalesce(w, 0) > i + 1 THEN 'impossible-cache-relationship'
  WHEN coalesce(r, 0) > o + 1 THEN 'impossible-reasoning-relationship' WHEN t + 1 < i + o THEN 'impossible-total-relationship' END AS reason, p IS NOT NULL AND [i, c, w, o, r, t] IS NOT DISTINCT FROM p AS same FROM l)
SELECT user_id, ordinal, CASE WHEN same THEN 'duplicate' WHEN reason IS NOT NULL THEN 'quarantine' ELSE 'usage' END AS kind, CASE WHEN NOT same THEN reason END AS reason,
  greatest(0, i - c - coalesce(w, 0)) AS fresh, greatest(0, t - i - o) AS unattributed FROM n""")
def n5_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _events(spark, sf_dir).withColumns(
        {
            "input": F.expr("k div 20 * 100"),
            "cached": F.expr("k div 20 * 30"),
            "write": F.when(k % 10 == 3, F.lit(None)).when(k % 10 == 4, F.lit(-1)).otherwise(F.expr("k div 50")),
            "output": F.expr("k div 30 * 10"),
            "reasoning": F.when(k % 10 == 5, F.lit(99)),
            "total": F.expr("k div 20 * 100 + k div 30 * 10") - F.when(k % 10 == 6, F.lit(5)).otherwise(0),
        }
    )
    return ingest.per_request(rows, ["user_id"]).select("user_id", "ordinal", "kind", "reason", "fresh", "unattributed")


_RUNNING = """v AS (SELECT *, sum(10 + k) OVER w + CASE WHEN k = 13 THEN 1000000 ELSE 0 END AS i, sum(k) OVER w AS c, sum(k % 5) OVER w AS o, sum(10 + k + k % 5) OVER w + CASE WHEN k = 13 THEN 1000000 ELSE 0 END AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ordinal))"""


@query(f"""{_BASE}, {_RUNNING}, d AS (SELECT *, row_number() OVER x AS rn, i - lag(i) OVER x AS di, c - lag(c) OVER x AS dc, o - lag(o) OVER x AS do_, t - lag(t) OVER x AS dt FROM v WINDOW x AS (PARTITION BY user_id ORDER BY ordinal))
SELECT user_id, ordinal, CASE WHEN rn = 1 THEN 'baseline' WHEN di = 0 AND dc = 0 AND do_ = 0 AND dt = 0 THEN 'duplicate' WHEN least(di, dc, do_, dt) < 0 OR dc > di + 1 THEN 'quarantine' ELSE 'usage' END AS kind,
  CASE WHEN rn = 1 OR (di = 0 AND dc = 0 AND do_ = 0 AND dt = 0) THEN NULL WHEN least(di, dc, do_, dt) < 0 THEN 'non-monotonic-cumulative' WHEN dc > di + 1 THEN 'impossible-cache-relationship' END AS reason,
  CAST(CASE WHEN rn = 1 THEN greatest(0, i - c) ELSE greatest(0, di - dc) END AS BIGINT) AS fresh FROM d""")
def n6_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ordinal")
    extra = F.when(F.col("k") == 13, F.lit(1_000_000)).otherwise(0)
    none = F.lit(None).cast("long")
    rows = _events(spark, sf_dir).withColumns(
        {
            "input": F.sum(10 + F.col("k")).over(w) + extra,
            "cached": F.sum("k").over(w),
            "write": none,
            "output": F.sum(F.col("k") % 5).over(w),
            "reasoning": none,
            "total": F.sum(10 + F.col("k") + F.col("k") % 5).over(w) + extra,
        }
    )
    return ingest.cumulative(rows, ["user_id"]).select("user_id", "ordinal", "kind", "reason", "fresh")


@query(f"""{_BASE}, l AS (SELECT *, min(occurred_at) OVER (PARTITION BY user_id) - to_milliseconds(600 * (user_id % 5)) AS anchor, lag(occurred_at) OVER (PARTITION BY user_id ORDER BY ordinal) AS before FROM e),
g AS (SELECT *, epoch_us(occurred_at) - epoch_us(coalesce(before, anchor)) AS gap FROM l)
SELECT user_id, ordinal, user_id % 2 = 0 AND min(CASE WHEN gap >= 0 AND gap < 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ordinal) = 1 AS suppressed FROM g""")
def n7_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks that were named up to 2.4 seconds before their first event."""
    first = F.min("occurred_at").over(Window.partitionBy("user_id"))
    rows = _events(spark, sf_dir).withColumn("named_at", first - F.make_dt_interval(secs=(F.col("user_id") % 5) * 0.6))
    return ingest.replayed(rows, ["user_id"], forked=F.col("user_id") % 2 == 0, anchor=F.col("named_at")).select("user_id", "ordinal", "suppressed")


@query(f"""{_BASE}, s AS (SELECT *, k % 10 AS req, k // 50 AS a, cents // 100000 AS b FROM e), l AS (SELECT *, [a, b] IS NOT DISTINCT FROM lag([a, b]) OVER (PARTITION BY user_id, req ORDER BY ordinal) AS duplicate FROM s),
m AS (SELECT *, max(CASE WHEN NOT duplicate THEN ordinal END) OVER (PARTITION BY user_id, req) AS last FROM l) SELECT user_id, req, ordinal, duplicate, NOT duplicate AND ordinal = last AS current FROM m""")
def n10_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumns({"req": F.col("k") % 10, "a": F.expr("k div 50"), "b": F.expr("cents div 100000")})
    return ingest.snapshots(rows, ["user_id", "req"], ["a", "b"]).select("user_id", "req", "ordinal", "duplicate", "current")


@query(f"""{_BASE} SELECT user_id, ordinal, last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS model,
  first_value(CASE WHEN event_type = 'click' THEN cents END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS header FROM e""")
def w4_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    model = ingest.carried(F.when(F.col("event_type") == "view", F.col("k")), ["user_id"])
    header = ingest.first_seen(F.when(F.col("event_type") == "click", F.col("cents")), ["user_id"])
    return rows.select("user_id", "ordinal", model.alias("model"), header.alias("header"))


@query(f"""{_BASE} SELECT user_id, ordinal, [k // 25, cents // 50000] IS NOT DISTINCT FROM lag([k // 25, cents // 50000]) OVER (PARTITION BY user_id ORDER BY ordinal) AS same FROM e""")
def w5_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumns({"a": F.expr("k div 25"), "b": F.expr("cents div 50000")})
    return ingest.snapshots(rows, ["user_id"], ["a", "b"]).select("user_id", "ordinal", F.col("duplicate").alias("same"))


@query(f"""{_BASE}, f AS (SELECT *, epoch_us(occurred_at) // 400000 AS t FROM e), g AS (SELECT *, t - coalesce(lag(t) OVER w, first_value(t) OVER w - 700000 * (user_id % 3)) AS gap FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ordinal))
SELECT user_id, ordinal, min(CASE WHEN gap >= 0 AND gap < 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ordinal) = 1 AS burst FROM g""")
def w6_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burst at the start of a log, on times that run 400,000 times as fast; the log was named up to 1.4 seconds before."""
    micros = F.expr("unix_micros(cast(occurred_at AS timestamp)) div 400000")
    at = lambda x: F.timestamp_micros(x).cast("timestamp_ntz")
    rows = _events(spark, sf_dir).withColumn("micros", micros)
    named = F.first("micros").over(Window.partitionBy("user_id").orderBy("ordinal")) - 700_000 * (F.col("user_id") % 3)
    rows = rows.withColumns({"occurred_at": at(F.col("micros")), "named_at": at(named)})
    return ingest.replayed(rows, ["user_id"], anchor=F.col("named_at")).select("user_id", "ordinal", F.col("suppressed").alias("burst"))


# The store: a request is (event_type, user, k div 10); its envelope is what the cents say.


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.col("ordinal") % 2).cast("string")).alias("source_id"),
        F.col("event_type").alias("harness"),
        F.col("user_id").cast("string").alias("logical_session_id"),
        F.expr("cast(k div 10 as string)").alias("request_id"),
        F.expr("ordinal div 3").alias("line_ordinal"),
        F.expr("cast(k div 30 as string)").alias("envelope_hash"),
        F.when(F.col("k") % 17 == 0, "quarantine").otherwise("usage").alias("kind"),
        F.col("ordinal").alias("seq"),
        "occurred_at",
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("/w/"), F.col("event_type")).alias("path"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("/d/"), F.col("k").cast("string"))).alias("cwd"),
        F.when(F.col("k") % 4 > 0, F.concat(F.lit("u"), F.expr("cast(k div 10 as string)"))).alias("turn_id"),
        "k",
    )


_BRONZE = f"""{_BASE}, b AS (SELECT 's' || (ordinal % 2) AS source_id, event_type AS harness, CAST(user_id AS VARCHAR) AS logical_session_id, CAST(k // 10 AS VARCHAR) AS request_id, ordinal // 3 AS line_ordinal, CAST(k // 30 AS VARCHAR) AS envelope_hash,
  CASE WHEN k % 17 = 0 THEN 'quarantine' ELSE 'usage' END AS kind, ordinal AS seq, occurred_at, 'p' || (user_id % 5) AS project_id, '/w/' || event_type AS path, event_type || ':' || user_id AS session_id,
  CASE WHEN k % 3 = 0 THEN '/d/' || k END AS cwd, CASE WHEN k % 4 > 0 THEN 'u' || (k // 10) END AS turn_id, k FROM e)"""


@query(f"""{_BRONZE}, old AS (SELECT * FROM b WHERE seq % 4 = 0) SELECT logical_session_id, line_ordinal, envelope_hash, min(seq) AS seq FROM b WHERE seq % 4 <> 0 AND NOT EXISTS (
  SELECT 1 FROM old WHERE old.logical_session_id = b.logical_session_id AND old.line_ordinal = b.line_ordinal AND old.envelope_hash = b.envelope_hash) GROUP BY 1, 2, 3""")
def k1_new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bronze(spark, sf_dir)
    return store.new_records(rows.where("seq % 4 <> 0"), rows.where("seq % 4 = 0")).select(*store.RAW_KEY, "seq")


@query(f"""{_BRONZE} SELECT harness, logical_session_id, request_id, seq, k FROM b QUALIFY row_number() OVER (PARTITION BY harness, logical_session_id, request_id ORDER BY seq DESC) = 1""")
def k2_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_bronze(spark, sf_dir), store.EVENT).select(*store.EVENT, "seq", "k")


@query(f"""{_BRONZE} SELECT project_id, arg_max(path, seq) AS path FROM b GROUP BY 1""")
def k3_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.projects(_bronze(spark, sf_dir))


@query(f"""{_BRONZE} SELECT session_id, arg_max(project_id, seq) AS project_id, arg_max(cwd, seq) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(occurred_at, seq) AS first_seen, arg_max(occurred_at, seq) AS last_seen FROM b GROUP BY 1""")
def k3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sessions(_bronze(spark, sf_dir))


@query(f"""{_BRONZE} SELECT turn_id, arg_min(session_id, seq) AS session_id, min(occurred_at) AS started_at FROM b WHERE turn_id IS NOT NULL GROUP BY 1""")
def k3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.turns(_bronze(spark, sf_dir))


@query("""SELECT c_custkey AS file_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def k6_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    return store.missing(files, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id")))


@query(f"""{_BRONZE} SELECT seq, CASE WHEN kind <> 'usage' THEN kind WHEN seq < max(CASE WHEN kind = 'usage' THEN seq END) OVER (PARTITION BY source_id, logical_session_id, request_id) THEN 'duplicate' ELSE 'normalized' END AS status FROM b""")
def k7_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_status(_bronze(spark, sf_dir)).select("seq", "status")


@query(f"""{_BRONZE} SELECT seq, source_id FROM b WHERE source_id <> 's1'""")
def k8_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_source(_bronze(spark, sf_dir), "s1").select("seq", "source_id")


@query(f"""{_BRONZE}, s AS (SELECT *, CASE WHEN kind <> 'usage' THEN kind WHEN seq < max(CASE WHEN kind = 'usage' THEN seq END) OVER (PARTITION BY source_id, logical_session_id, request_id) THEN 'duplicate' ELSE 'normalized' END AS status FROM b)
SELECT source_id, harness, (SELECT count(DISTINCT x.logical_session_id) FROM b x WHERE x.source_id = s.source_id) AS files, count(*) AS raw_records, count(*) FILTER (WHERE status = 'quarantine') AS quarantined, count(*) FILTER (WHERE status = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE status = 'normalized') AS normalized, (SELECT count(*) FROM (SELECT DISTINCT harness, logical_session_id, request_id FROM b x WHERE x.harness = s.harness AND kind = 'usage')) AS harness_events FROM s GROUP BY 1, 2""")
def q12_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bronze(spark, sf_dir)
    files = rows.select("source_id", F.col("logical_session_id").alias("file_id")).distinct()
    return store.counters(rows, files, rows.where("kind = 'usage'").select(*store.EVENT).distinct())


@query(f"""{_BRONZE}, s AS (SELECT *, max(CASE WHEN kind = 'usage' THEN seq END) OVER (PARTITION BY source_id, logical_session_id, request_id) AS last FROM b)
SELECT harness, logical_session_id, request_id, seq FROM s WHERE kind = 'usage' AND seq = last AND occurred_at >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY harness, logical_session_id, request_id ORDER BY seq DESC) = 1""")
def q13_renormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.events(_bronze(spark, sf_dir), "2024-01-10").select(*store.EVENT, "seq")
