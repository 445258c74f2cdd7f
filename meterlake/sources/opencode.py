"""Messages of a SQLite store: one request per assistant message, which is delivered again when it changes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.metrics import to_nano
from meterlake.operators.graph import nearest
from meterlake.operators.ingest import safe
from meterlake.session import written
from meterlake.sources.records import filled, is_object, shaped, strings

# The token counts, and those of them that stand under cache.
COUNTS, CACHE = ("input", "output", "reasoning", "read", "write", "total"), ("read", "write")
# What is read of a message and of its tokens; each JSON text is parsed once.
_MESSAGE = strings(("role", "parentID", "providerID", "modelID", "cost", "tokens")) + ", path struct<cwd:string>, time struct<created:string,completed:string>"
_TOKENS = strings(("input", "output", "reasoning", "total")) + ", cache struct<read:string,write:string>"


def signature(path: str) -> tuple[int, int] | None:
    """Size and last change of a store with its write-ahead log, if that is not empty; None if there is no store."""
    if not os.path.exists(path):
        return None
    parts = [os.stat(p) for p in (path, f"{path}-wal") if os.path.exists(p) and (p == path or os.path.getsize(p))]
    return sum(p.st_size for p in parts), max(p.st_mtime_ns // 1_000_000 for p in parts)


def count(given: Column) -> tuple[Column, Column]:
    """A count (0 where it is missing or null) and whether it is valid."""
    value = safe(given.try_cast("double"))
    return F.coalesce(value, F.lit(0)), given.isNull() | value.isNotNull()


def millis(x: Column) -> Column:
    return F.when(x > 0, F.timestamp_millis(x.cast("long"))).cast("timestamp_ntz")


def opencode(messages: DataFrame, file: str = "opencode.db") -> DataFrame:
    """Records of messages (sqlite.MESSAGES, and optionally delivery: the order of delivery, 0 if absent).

    Output includes reasoning; what the total holds beyond the parts is unattributed. An assistant message without any
    token is no request. A delivery that changes nothing of the accounting is a duplicate.
    """
    rows = messages if "delivery" in messages.columns else messages.withColumn("delivery", F.lit(0).cast("long"))
    said, tokens = F.col("__said"), F.col("__tokens")
    rows = rows.withColumn("good", is_object("data")).withColumn("__said", F.from_json("data", _MESSAGE)).withColumn("__tokens", F.from_json(said["tokens"], _TOKENS))
    asked = said["tokens"].isNotNull() & F.arrays_overlap(F.json_object_keys(said["tokens"]), F.array(*map(F.lit, ("input", "output", "reasoning", "cache", "total"))))
    told = {name: tokens["cache"][name] if name in CACHE else tokens[name] for name in COUNTS}
    parsed = {name: count(value) for name, value in told.items()}
    valid = F.lit(True)
    for _, ok in parsed.values():
        valid = valid & ok
    cost = said["cost"].try_cast("double")
    rows = rows.select(
        *(c for c in rows.columns if c not in ("data", "__said", "__tokens")),
        filled(said["role"]).alias("role"),
        filled(said["parentID"]).alias("parent"),
        asked.alias("asked"),
        *(value.alias(name) for name, (value, _) in parsed.items()),
        valid.alias("valid"),
        *(told[name].isNotNull().alias(f"{name}_given") for name in ("reasoning", "write", "total")),
        F.when((cost >= 0) & (cost < float("inf")), cost).alias("cost"),
        F.coalesce(filled(said["path"]["cwd"]), F.nullif("session_directory", F.lit(""))).alias("cwd"),
        F.coalesce(*(said["time"][n].try_cast("double") for n in ("created", "completed")), F.col("time_created").cast("double")).alias("at"),
        said["time"]["completed"].alias("done"),
        filled(said["providerID"]).alias("provider"),
        filled(said["modelID"]).alias("model"),
    )
    # Written before it is filtered: a filter on what is parsed would be moved below the parsing and parse again.
    rows = written(rows, "messages")
    bad = rows.where(~F.col("good"))
    # Of a message that was delivered more than once, the latest node.
    last = rows.where("good").groupBy(F.col("id").alias("node")).agg(F.max_by(F.struct("parent", "role"), F.struct("delivery", "time_updated", "rowid")).alias("last"))
    nodes = last.select(F.lit("all").alias("session"), "node", "last.parent", "last.role", F.lit(0).cast("long").alias("ordinal"))
    rows = rows.where("good AND role = 'assistant' AND asked")
    rows = rows.withColumns(
        {
            "output": F.col("output") + F.col("reasoning"),
            "reasoned": F.when(F.col("reasoning_given"), F.col("reasoning")),
            "wrote": F.col("write_given"),
            "beyond": F.when(F.col("total_given"), F.greatest(F.lit(0), F.col("total") - F.col("input") - F.col("read") - F.col("write") - F.col("output") - F.col("reasoning"))).otherwise(F.lit(0)),
        }
    )
    nothing = F.col("input") + F.col("read") + F.col("write") + F.col("output") + F.col("beyond") == 0
    # What decides whether a delivery is another snapshot.
    state = F.struct("input", "read", "write", "wrote", "output", "reasoned", "beyond", "cost", "provider", "model", "parent", "cwd", "session_directory", "session_parent_id", "at", "done")
    counted = F.col("valid") & ~nothing
    before = F.last(F.when(counted, state), ignorenulls=True).over(Window.partitionBy("id").orderBy("delivery", "time_updated").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("same", counted & before.eqNullSafe(state))
    turns = nearest(nodes, ("user",)).select(F.col("node").alias("parent"), F.col("ancestor").alias("turn_id"))
    rows = rows.join(turns, "parent", "left")
    kind = F.when(~F.col("valid"), "quarantine").when(nothing, "skipped").when(F.col("same"), "duplicate").otherwise("usage")
    records = shaped(
        rows,
        file=F.lit(file),
        ordinal="rowid",
        kind=kind,
        reason=F.when(~F.col("valid"), "invalid-token-count"),
        logical_session_id="session_id",
        request_id="id",
        parent_id="parent",
        turn_id="turn_id",
        raw_provider_id="provider",
        raw_model_id="model",
        cwd="cwd",
        occurred_at=F.coalesce(millis(F.col("at")), millis(F.col("time_created"))),
        fresh_input_tokens="input",
        cache_read_input_tokens="read",
        cache_write_input_tokens="write",
        cache_write_available="wrote",
        output_tokens="output",
        reasoning_output_tokens="reasoned",
        unattributed_tokens="beyond",
        cost_nano_usd=to_nano("cost"),
        query_source=F.when(F.col("session_parent_id").isNotNull(), "subagent").otherwise("main"),
    )
    return records.unionByName(shaped(bad, file=F.lit(file), ordinal="rowid", kind=F.lit("quarantine"), reason=F.lit("malformed-json")))
