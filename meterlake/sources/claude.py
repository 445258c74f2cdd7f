"""Transcripts whose assistant lines carry a response's usage, written again as the response grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.ingest import carried, is_last, safe
from meterlake.session import written
from meterlake.sources.lines import logical_id
from meterlake.sources.records import carrying, filled, graph_alone, instant, malformed, modified, quarantined, shaped, strings, with_turns

CLASSES = {"input": "input_tokens", "read": "cache_read_input_tokens", "output": "output_tokens"}
WRITTEN = "cache_creation_input_tokens"
PARTS = ("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")
# What is read of a line and of its usage; each JSON text is parsed once.
_LINE = strings(("uuid", "parentUuid", "parent_uuid", "requestId", "request_id", "type", "cwd", "isSidechain", "agentId", "timestamp")) + ", message struct<id:string,role:string,model:string,usage:string>"
_USAGE = strings((*CLASSES.values(), WRITTEN)) + ", cache_creation struct<" + ",".join(f"{n}:string" for n in PARTS) + ">"
VECTOR = ["input", "read", "write", "output"]


def parsed(lines: DataFrame) -> DataFrame:
    """What accounting needs of each line (file, ordinal, text); a row without text stays, all else null, as in broken lines.

    Writes count once: the total if there is one, else its parts.
    """
    j, said, usage = F.col("__line"), F.col("__line")["message"], F.col("__usage")
    rows = lines.withColumn("broken", malformed()).withColumn("__line", F.from_json(F.when(~F.col("broken"), F.col("text")), _LINE)).withColumn("__usage", F.from_json(said["usage"], _USAGE))
    total, parts = usage[WRITTEN], [usage["cache_creation"][p] for p in PARTS]
    count = lambda x: F.when(x.isNull(), F.lit(0)).otherwise(safe(x.try_cast("double")))
    message, request = filled(said["id"]), filled(j["requestId"], j["request_id"])
    model = filled(said["model"])
    side = (j["isSidechain"] == "true") | j["agentId"].isNotNull()
    return rows.select(
        *carrying(lines),
        "broken",
        filled(j["uuid"]).alias("node"),
        filled(j["parentUuid"], j["parent_uuid"]).alias("parent"),
        filled(said["role"], j["type"]).alias("role"),
        filled(j["cwd"]).alias("cwd"),
        F.coalesce((j["type"] == "assistant") & said["usage"].isNotNull(), F.lit(False)).alias("asked"),
        *(count(usage[n]).alias(c) for c, n in CLASSES.items()),
        F.when(total.isNotNull(), count(total)).otherwise(count(parts[0]) + count(parts[1])).alias("write"),
        F.coalesce(total, *parts).isNotNull().alias("known"),
        F.coalesce(F.when(message.isNotNull(), F.concat_ws(":", message, request)), request, filled(j["uuid"])).alias("key"),
        F.when(model != "<synthetic>", model).alias("model"),
        F.when(F.coalesce(side, F.lit(False)), "subagent").otherwise("main").alias("query_source"),
        instant(filled(j["timestamp"])).alias("occurred_at"),
    )


def invalid() -> Column:
    """Whether a count of the snapshot is none."""
    return F.greatest(*(F.col(c).isNull().cast("int") for c in VECTOR)) == 1


def records(rows: DataFrame) -> DataFrame:
    """Records of parsed lines. The session is the file's (logical_id), the turn the nearest user message above. Values are
    carried along a file, so its parsed lines meet in one task of the window, spilled to disk where they are many."""
    found = rows.withColumn("cwd", carried("cwd", ["file"])).where("asked")
    # A snapshot is compared with the last valid one of its response.
    so_far = Window.partitionBy("file", "key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~invalid(), F.struct(*VECTOR)), ignorenulls=True).over(so_far)
    found = with_turns(found.withColumn("duplicate", ~invalid() & before.eqNullSafe(F.struct(*VECTOR))), rows.select("file", "ordinal", "node", "parent", "role"), ("user",))
    reason = F.when(F.col("key").isNull(), "missing-response-id").when(invalid(), "invalid-token-count")
    kind = F.when(reason.isNotNull(), "quarantine").when(F.col("duplicate"), "duplicate").when(sum((F.col(c) for c in VECTOR), F.lit(0)) == 0, "skipped").otherwise("usage")
    out = shaped(
        found,
        file="file",
        ordinal="ordinal",
        kind=kind,
        reason=reason,
        logical_session_id=logical_id(),
        request_id="key",
        parent_id="parent",
        turn_id="turn_id",
        raw_model_id="model",
        cwd="cwd",
        occurred_at=F.coalesce(F.col("occurred_at"), modified(rows)),
        fresh_input_tokens="input",
        cache_read_input_tokens="read",
        cache_write_input_tokens="write",
        cache_write_available="known",
        output_tokens="output",
        query_source="query_source",
    )
    return out.unionByName(quarantined(rows.where("broken")))


def context(rows: DataFrame) -> DataFrame:
    """The parsed lines that later ones depend on: the last directory, the last valid snapshot of each response, and of every
    message its place in the graph alone."""
    valid = F.col("asked") & ~invalid()
    marked = rows.where("NOT broken").withColumns({"place": is_last(F.col("cwd").isNotNull(), ["file"]), "last": is_last(valid, ["file", "key"])})
    return graph_alone(marked, marked["last"] | marked["place"]).drop("place", "last")


def claude(lines: DataFrame) -> DataFrame:
    """Records of lines (file, ordinal, text)."""
    return records(written(parsed(lines), "parsed"))
