"""Rollouts whose token counts come per request or as running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.ingest import VECTOR, carried, cumulative, first_seen, is_first, is_last, per_request, replayed
from meterlake.session import written
from meterlake.sources.lines import logical_id
from meterlake.sources.records import carrying, instant, malformed, modified, quarantined, shaped

# Names of the parts of a vector; the first that is there counts.
PARTS = {
    "input": ("input_tokens", "inputTokens"),
    "cached": ("cached_input_tokens", "cachedInputTokens", "cache_read_input_tokens"),
    "write": ("cache_write_input_tokens", "cacheWriteInputTokens"),
    "output": ("output_tokens", "outputTokens"),
    "reasoning": ("reasoning_output_tokens", "reasoningOutputTokens"),
    "total": ("total_tokens", "totalTokens"),
}
#: Parts of which it matters whether they were given at all.
OPTIONAL = ("write", "reasoning")
FORKS = ("subagent", "fork")


# What is read of a line, of what opens or renews a session, of an event and of what it holds; each JSON text is parsed once. What
# may be an object is kept as text.
_LINE = "type string, timestamp string, payload string, event_msg string, session_meta string, turn_context string"
_OWN = "model_provider string, model string, cwd string, turn_id string, source string, forked_from_id string"
_EVENT = "type string, info string, total_token_usage string, usage string, payload string"


def _object(*texts: Column) -> Column:
    """The first of these texts that is an object."""
    return F.coalesce(*(F.when(x.startswith("{"), x) for x in texts))


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _number(v: Column, keys: Column, part: str) -> Column:
    value = F.coalesce(*(v[n] for n in PARTS[part])).try_cast("double")
    number = F.coalesce(F.when(F.abs(value) < float("inf"), value.cast("long")), F.lit(0).cast("long"))
    return (F.when(F.arrays_overlap(keys, F.array(*map(F.lit, PARTS[part]))), number) if part in OPTIONAL else number).alias(part)


def _time(x: Column) -> Column:
    number = x.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_millis(number.cast("long")).cast("timestamp_ntz")).otherwise(instant(x))


def parsed(lines: DataFrame) -> DataFrame:
    """What accounting needs of each line (file, ordinal, text); lines that say nothing about it are left out. A row without text
    stays as it is, all else null.

    meta: it opens a session. token: last (one request) or total (a running sum), with its vector.
    """
    kept = carrying(lines)
    line, own, event, inner, info, v = (F.col(f"__{n}") for n in ("line", "own", "event", "inner", "info", "v"))
    # Asked of the text alone: a filter on what is parsed would be moved below the parsing and parse again.
    told = F.col("text").isNull() | F.col("text").rlike("session_meta|turn_context|token_count") | malformed()
    rows = lines.where(told).select(*kept, "text", malformed().alias("broken"), F.from_json("text", _LINE).alias("__line"))
    meta = line["type"].eqNullSafe("session_meta") | _object(line["session_meta"]).isNotNull()
    turn = line["type"].eqNullSafe("turn_context") | _object(line["turn_context"]).isNotNull()
    rows = rows.withColumns({"meta": meta, "__turn": turn & ~meta, "__payload": F.coalesce(line["payload"], F.from_json(line["event_msg"], "payload string")["payload"])})
    opening = F.when(F.col("meta"), _object(line["session_meta"], line["payload"], F.col("text"))).when(F.col("__turn"), _object(line["turn_context"], line["payload"], F.col("text")))
    rows = rows.withColumns({"__own": F.from_json(opening, _OWN), "__event": F.from_json(_object(F.col("__payload")), _EVENT)})
    rows = rows.withColumns({"__inner": F.from_json(_object(event["payload"]), "type string, total_token_usage string"), "__info": F.from_json(_object(event["info"]), "last_token_usage string")})
    counts = F.coalesce(inner["type"], event["type"]).eqNullSafe("token_count") | line["type"].eqNullSafe("token_count")
    rows = rows.withColumns({"__last": F.when(counts, _object(info["last_token_usage"])), "__total": F.when(counts, _object(event["total_token_usage"], event["usage"], inner["total_token_usage"]))})
    given = F.coalesce("__last", "__total")
    names = ", ".join(f"{n} string" for part in VECTOR for n in PARTS[part])
    rows = rows.withColumns({"__v": F.from_json(given, names), "__keys": F.json_object_keys(given)})
    forked = _filled(own["forked_from_id"]).isNotNull() | own["source"].isin(*FORKS) | F.arrays_overlap(F.json_object_keys(_object(own["source"])), F.array(*map(F.lit, FORKS)))
    return rows.select(
        *kept,
        "broken",
        "meta",
        F.when(F.col("meta"), F.coalesce(forked, F.lit(False))).alias("forked"),
        F.when(F.col("meta"), _filled(own["model_provider"])).alias("provider"),
        _filled(own["model"]).alias("model"),
        F.when(F.col("__turn"), _filled(own["turn_id"])).alias("turn_id"),
        _filled(own["cwd"]).alias("cwd"),
        F.when(F.col("__last").isNotNull(), "last").when(F.col("__total").isNotNull(), "total").alias("token"),
        F.struct(*(_number(v, F.col("__keys"), part) for part in VECTOR)).alias("vector"),
        _time(line["timestamp"]).alias("occurred_at"),
        F.lit(None).cast("boolean").alias("settled"),
    )


FILE = ["file"]


def _carried(rows: DataFrame) -> DataFrame:
    """Token counts with what the file has said up to them. Only its first session_meta counts."""
    rows = rows.where("NOT broken").withColumn("first", is_first(F.col("meta"), FILE)).where("first OR NOT meta")
    marks = {"provider": first_seen("provider", FILE), "forked": first_seen("forked", FILE), "named_at": first_seen(F.when(F.col("first"), F.struct("occurred_at")), FILE)["occurred_at"]}
    marks |= {c: carried(c, FILE) for c in ("model", "turn_id", "cwd")}
    rows = rows.withColumns(marks).where("token IS NOT NULL").select("*", *(F.col("vector")[c].alias(c) for c in VECTOR))
    return replayed(rows, FILE, forked=F.coalesce("forked", F.lit(False)), anchor=F.col("named_at"), settled=F.col("settled"))


def records(rows: DataFrame) -> DataFrame:
    """Records of parsed lines. The session is the file. The first running total of a file is a baseline; what a forked session
    replays at its start is skipped. Values are carried along a file, so its parsed lines meet in one task of the window,
    spilled to disk where they are many."""
    tokens = _carried(rows)
    single = per_request(tokens.where("token = 'last'"), FILE)
    single = single.withColumns({f"d_{c}": F.col(c) for c in ("cached", "write", "output", "reasoning")})
    total = cumulative(tokens.where("token = 'total'"), FILE)
    names = ["file", "ordinal", "kind", "reason", "suppressed", "provider", "model", "turn_id", "cwd", "occurred_at", "fresh", "unattributed", "d_cached", "d_write", "d_output", "d_reasoning", *(["modified_at"] if "modified_at" in rows.columns else [])]
    both = single.select(*names).union(total.select(*names))
    counts = F.when(F.col("suppressed") | (F.col("kind") == "baseline"), "skipped").otherwise(F.col("kind"))
    found = shaped(
        both,
        file="file",
        ordinal="ordinal",
        kind=counts,
        reason=F.when(counts == "quarantine", F.col("reason")),
        logical_session_id=logical_id(),
        request_id=F.concat_ws(":", logical_id(), "ordinal"),
        turn_id="turn_id",
        raw_provider_id="provider",
        raw_model_id="model",
        cwd="cwd",
        occurred_at=F.coalesce(F.col("occurred_at"), modified(rows)),
        fresh_input_tokens="fresh",
        cache_read_input_tokens="d_cached",
        cache_write_input_tokens=F.coalesce("d_write", F.lit(0)),
        cache_write_available=F.col("d_write").isNotNull(),
        output_tokens="d_output",
        reasoning_output_tokens="d_reasoning",
        unattributed_tokens="unattributed",
    )
    return found.unionByName(quarantined(rows.where("broken")))


def context(rows: DataFrame) -> DataFrame:
    """The parsed lines that later ones depend on: the first session_meta, the last model, turn and directory, and the last vector
    of each kind with what was decided of it (settled)."""
    decided = _carried(rows).select("file", "ordinal", F.col("suppressed").alias("decided"))
    rows = rows.where("NOT broken").withColumn("needed", is_first(F.col("meta"), FILE)).where("needed OR NOT meta")
    needed = F.col("needed")
    for c in ("model", "turn_id", "cwd"):
        needed = needed | is_last(F.col(c).isNotNull(), FILE)
    for kind in ("last", "total"):
        needed = needed | is_last(F.col("token") == kind, FILE)
    names = [c for c in rows.columns if c not in ("needed", "settled")]
    kept = rows.withColumn("needed", needed).where("needed")
    return kept.join(decided, ["file", "ordinal"], "left").select(*names, F.col("decided").alias("settled"))


def codex(lines: DataFrame) -> DataFrame:
    """Records of lines (file, ordinal, text)."""
    return records(written(parsed(lines), "parsed"))
