"""Whole runs of the sync job over logs that Spark writes from the events table: three runs, each with the next third."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.config import Config
from meterlake.operators import store
from meterlake.plans.facts import table
from meterlake.plans.registry import query
from meterlake.session import shared_folder, written
from meterlake.sources.codex import codex
from meterlake.streaming import sync as job
from meterlake.streaming.commits import Store

# A request is (user, k div 10); the log of a third is a file for each user. Folders of later thirds come first by name.
_E = """WITH e AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ntile(3) OVER (ORDER BY event_id) AS third FROM events),
r AS (SELECT 's' || user_id AS session, 's' || user_id || ':' || (k // 10) AS request_id, k AS fresh, k % 50 AS output, ts AS occurred_at, event_id, third FROM e WHERE k % 19 <> 0)"""
_FOLDERS = ("z", "m", "a")


def _records(spark: SparkSession, sf_dir: str, thirds: bool = True) -> DataFrame:
    """user_id, event_id, third (1 of all, without thirds) and the line of each event; every 19th is blank."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", k.alias("k"))
    # Cuts need not be exact: the order of writing is what results depend on. Exact ones would pass all ids through the driver.
    cuts = rows.approxQuantile("event_id", [1 / 3, 2 / 3], 0.001) if thirds else []
    third = sum(((F.col("event_id") > c).cast("int") for c in cuts), F.lit(1))
    usage = F.struct(F.col("k").alias("input"), (F.col("k") % 50).alias("output"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    line = F.to_json(F.struct(F.expr("cast(k div 10 AS string)").alias("id"), F.concat(F.lit("s"), "user_id").alias("sessionId"), at, usage.alias("usage")))
    return rows.select("user_id", "event_id", third.alias("third"), F.when(F.col("k") % 19 == 0, F.lit("")).otherwise(line).alias("line"))


def _append(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the lines of each user to a file of their own, as the tools that are logged do; the number of files."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    # Under another name until it is whole, so that a task may run twice.
    attempt, user, out, n = TaskContext.get().taskAttemptId(), None, None, 0
    aside = lambda u: f"{root}/.{u}.{attempt}"

    def close() -> None:
        if out is not None:
            out.close()
            files.move(aside(user), f"{root}/{user}.txt")

    for batch in batches:
        for own, rows in groupby(zip(batch["user_id"].to_pylist(), batch["line"].to_pylist(), strict=True), itemgetter(0)):
            if out is None or own != user:
                close()
                user, n = own, n + 1
                out = files.open_output_stream(aside(user))
            out.write("".join(f"{line}\n" for _, line in rows).encode())
    close()
    yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})


def logged(rows: DataFrame, folder: str) -> int:
    """Writes a log of each user below a folder, in the order of events; how many there are."""
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", "event_id").select("user_id", "line")
    return dealt.mapInArrow(lambda it: _append(it, folder), "files long").agg(F.sum("files")).first()[0]


def synced(spark: SparkSession, sf_dir: str, thirds: bool = True) -> Store:
    """A store after a run for each third, and one that finds nothing new; or after one run over all events."""
    base, rows = shared_folder(spark, "sync"), _records(spark, sf_dir, thirds)
    st, sources = Store(spark, f"{base}/store", 16), [job.Source("one", "pi", f"{base}/logs", "*.txt")]
    for third, name in enumerate(_FOLDERS if thirds else _FOLDERS[:1], 1):
        logged(rows.where(F.col("third") == third) if thirds else rows, f"{base}/logs/{name}")
        job.sync(st, sources)
    if thirds and job.sync(st, sources)["files"]:
        raise RuntimeError("a run without news read a log")
    return st


@query(f"""{_E} SELECT session AS logical_session_id, request_id, fresh AS fresh_input_tokens, output AS output_tokens, occurred_at FROM r QUALIFY row_number() OVER (PARTITION BY session, request_id ORDER BY event_id DESC) = 1""")
def q14_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after three runs: of a request's snapshots the one that was written last, whatever its file is called."""
    return synced(spark, sf_dir).read("facts").select("logical_session_id", "request_id", "fresh_input_tokens", "output_tokens", "occurred_at")


@query(f"""{_E}, n AS (SELECT count(DISTINCT user_id) AS files, CAST(0 AS BIGINT) AS quarantined FROM e), u AS (SELECT count(*) AS usage, count(DISTINCT request_id) AS normalized FROM r)
SELECT 'one' AS source_id, 'pi' AS harness, files, usage + quarantined AS raw_records, quarantined, usage - normalized AS duplicates, normalized, normalized AS harness_events FROM n, u""")
def q14_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.counters(synced(spark, sf_dir, thirds=False))


@query(f"""{_E} SELECT session AS logical_session_id, request_id, fresh AS fresh_input_tokens FROM r WHERE occurred_at >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY session, request_id ORDER BY event_id DESC) = 1""")
def q13_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after a renormalisation under a cutoff, which one commit switches; crashed work of another change is not seen."""
    st = synced(spark, sf_dir, thirds=False)
    job.renormalise(st, Config(cutoff="2024-01-10"))
    lost = st.begin()
    lost.append("facts", st.read("facts"), "logical_session_id")
    return st.read("facts").select("logical_session_id", "request_id", "fresh_input_tokens")


@query(f"""{_E} SELECT session AS logical_session_id, request_id, max(event_id) AS event_id FROM r GROUP BY 1, 2""")
def k2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last writes of three batches, the order of which is not that of file names."""
    rows = _records(spark, sf_dir).where("line <> ''")
    file = F.element_at(F.array(*map(F.lit, _FOLDERS)), F.col("third"))
    seq = F.struct(F.col("third").cast("long").alias("commit"), file.alias("file"), F.col("event_id").alias("line_ordinal"))
    session = F.get_json_object("line", "$.sessionId")
    bronze = rows.select(F.lit("pi").alias("harness"), session.alias("logical_session_id"), F.concat_ws(":", session, F.get_json_object("line", "$.id")).alias("request_id"), seq.alias("seq"), "event_id")
    return store.latest(bronze, store.EVENT).select("logical_session_id", "request_id", "event_id")


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN k % 5 = 4 THEN 'malformed-json' END AS reason FROM e WHERE k % 5 = 4 OR k % 2 = 1""")
def k1_replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is stored twice, and again after half of it was there: every record once, those without session too."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").where((k % 5 == 4) | (k % 2 == 1)).select(
        F.when(k % 5 != 4, F.col("user_id").cast("string")).alias("logical_session_id"), F.col("event_id").alias("line_ordinal"), F.when(k % 5 != 4, F.col("event_id").cast("string")).alias("envelope_hash"),
        F.col("event_id").alias("seq"), "event_id", F.when(k % 5 == 4, "malformed-json").alias("reason"),
    )
    held = store.new_records(rows.where("event_id % 2 = 0"), None)
    held = held.union(store.new_records(rows.union(rows), held))
    return held.union(store.new_records(rows, held)).select("event_id", "reason")


@query("""WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v AS (SELECT *, k // 25 AS i, k // 60 AS c, k // 100 AS o, CASE WHEN k % 4 = 0 THEN 0 ELSE k // 25 + k // 100 + k % 3 END AS t FROM e),
l AS (SELECT *, lag([i, c, o, t]) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM v)
SELECT 'r' || user_id AS logical_session_id, 'r' || user_id || ':' || event_id AS request_id, CASE WHEN p = [i, c, o, t] THEN 'duplicate' WHEN c > i + 1 THEN 'quarantine' WHEN t + 1 < i + o THEN 'quarantine' ELSE 'usage' END AS kind,
  CASE WHEN p = [i, c, o, t] THEN NULL WHEN c > i + 1 THEN 'impossible-cache-relationship' WHEN t + 1 < i + o THEN 'impossible-total-relationship' END AS reason, greatest(0, i - c) AS fresh_input_tokens, o AS output_tokens, greatest(0, t - i - o) AS unattributed_tokens FROM l""")
def n3_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts whose counts come in either spelling, in either shape of event, and every fourth without a total; the file is the session."""
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", k).repartition("user_id")
    pick = lambda n, x: F.expr(f"CASE WHEN k % 3 = {n} THEN {x} END")
    vector = F.struct(
        F.expr("CASE WHEN k % 2 = 0 THEN k div 25 END").alias("input_tokens"), F.expr("CASE WHEN k % 2 = 1 THEN cast(k div 25 AS string) END").alias("inputTokens"),
        pick(0, "k div 60").alias("cached_input_tokens"), pick(1, "k div 60").alias("cachedInputTokens"), pick(2, "k div 60").alias("cache_read_input_tokens"),
        F.expr("CASE WHEN k % 3 > 0 THEN k div 100 END").alias("output_tokens"), pick(0, "k div 100").alias("outputTokens"), F.expr("CASE WHEN k % 4 > 0 THEN k div 25 + k div 100 + k % 3 END").alias("total_tokens"),
    )
    body = F.struct(F.lit("token_count").alias("type"), F.struct(vector.alias("last_token_usage")).alias("info"))
    text = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.lit("event_msg").alias("type"), body.alias("payload")))).otherwise(F.to_json(F.struct(F.struct(body.alias("payload")).alias("event_msg"))))
    lines = rows.select(F.concat(F.lit("/x/r"), "user_id", F.lit(".rollout")).alias("file"), F.col("event_id").alias("ordinal"), text.alias("text"))
    got = codex(written(lines, "log"))
    return got.select("logical_session_id", "request_id", "kind", "reason", "fresh_input_tokens", "output_tokens", "unattributed_tokens")
