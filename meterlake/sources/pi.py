"""Session logs with a header line and one usage object for each assistant message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import to_nano
from meterlake.operators.ingest import clamped, is_first
from meterlake.session import written
from meterlake.sources.records import alone, carrying, filled, instant, malformed, modified, quarantined, shaped, strings, with_turns

# The spellings of each field; the first that is there counts.
FRESH = ("input", "inputTokens", "input_tokens")
READ = ("cacheRead", "cache_read", "cachedInput")
WRITE = ("cacheWrite", "cache_write")
OUTPUT = ("output", "outputTokens", "output_tokens")
REASONING = ("reasoning", "reasoningTokens", "reasoning_tokens")
TOTAL = ("totalTokens", "total_tokens")
COST = ("cost.total", "costTotal", "cost_total")
ANY = ("input", "output", "totalTokens", "total_tokens", "cacheRead", "cacheWrite")
HEADERS, IDS, PARENTS, TIMES = ("header", "session", "session_header"), ("id", "uuid", "messageId"), ("parentId", "parent_id"), ("timestamp", "ts", "createdAt", "created_at")
USER = ("user", "human")
# What is read of a line and of its usage; each JSON text is parsed once.
_LINE = strings((*IDS, *PARENTS, *TIMES, "type", "role", "sessionId", "session_id", "cwd", "provider", "model", "usage")) + ", message struct<usage:string,role:string,provider:string,model:string>"
_USAGE = strings(dict.fromkeys(n.split(".")[0] for names in (FRESH, READ, WRITE, OUTPUT, REASONING, TOTAL, COST) for n in names))


def given(usage: Column, names: tuple[str, ...]) -> Column:
    """The value of the first spelling that is there, as a number; null if it is none."""
    at = lambda n: F.get_json_object(usage[n.split(".")[0]], "$." + n.split(".", 1)[1]) if "." in n else usage[n]
    return F.coalesce(*map(at, names)).try_cast("double")


def parsed(lines: DataFrame) -> DataFrame:
    """What accounting needs of each line (file, ordinal, text); a row without text stays, all else null, as in broken lines."""
    line, message, counts_of = F.col("__line"), F.col("__line")["message"], F.col("__usage")
    id_ = filled(*(line[n] for n in IDS))
    rows = lines.withColumn("broken", malformed()).withColumn("__line", F.from_json(F.when(~F.col("broken"), F.col("text")), _LINE))
    rows = rows.withColumn("usage", F.coalesce(line["usage"], message["usage"])).withColumn("__usage", F.from_json("usage", _USAGE))
    keys = F.coalesce(F.json_object_keys("usage"), F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    reasoning, cost = given(counts_of, REASONING), given(counts_of, COST)
    counts = {"fresh": FRESH, "read": READ, "write": WRITE, "output": OUTPUT, "total": TOTAL}
    return rows.select(
        *carrying(lines),
        "broken",
        F.coalesce(line["type"].isin(*HEADERS) & id_.isNotNull(), F.lit(False)).alias("header"),
        id_.alias("node"),
        filled(*(line[n] for n in PARENTS)).alias("parent"),
        filled(line["role"], message["role"]).alias("role"),
        filled(line["sessionId"], line["session_id"]).alias("own_session"),
        filled(line["cwd"]).alias("cwd"),
        has(ANY).alias("asked"),
        *(clamped(given(counts_of, names)).alias(n) for n, names in counts.items()),
        F.when(reasoning.isNotNull() & ~F.isnan(reasoning), clamped(reasoning)).alias("reasoning"),
        F.when(cost.isNotNull() & ~F.isnan(cost), to_nano(F.greatest(F.lit(0.0), cost))).alias("cost_nano"),
        has(WRITE).alias("wrote"),
        filled(message["provider"], line["provider"]).alias("provider"),
        filled(message["model"], line["model"]).alias("model"),
        instant(filled(*(line[n] for n in TIMES))).alias("occurred_at"),
    )


def records(rows: DataFrame) -> DataFrame:
    """Records of parsed lines. What the total holds beyond its parts is unattributed; output includes reasoning."""
    # What the first headers of a file say holds from their line on. Few lines are headers: no other is sorted for it.
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ordinal", F.col(c).alias("value"))))
    heads = written(rows.where("header").groupBy("file").agg(first("node").alias("__named"), first("cwd").alias("__place")), "heads")
    so_far = lambda c: F.when(F.col(c)["ordinal"] <= F.col("ordinal"), F.col(c)["value"])
    found = rows.where("asked").join(heads, "file", "left")
    found = found.withColumns({"session": F.coalesce(so_far("__named"), F.col("own_session"), F.lit("unknown")), "cwd": F.coalesce(F.col("cwd"), so_far("__place"))}).drop("__named", "__place")
    found = with_turns(found, rows.select("file", "ordinal", "node", "parent", "role"), USER)
    known = sum((F.col(c) for c in ("fresh", "read", "write", "output")), F.lit(0))
    out = shaped(
        found,
        file="file",
        ordinal="ordinal",
        kind=F.lit("usage"),
        logical_session_id="session",
        request_id=F.concat_ws(":", F.col("session"), F.coalesce("node", F.concat(F.lit("line-"), "ordinal"))),
        parent_id="parent",
        turn_id="turn_id",
        raw_provider_id="provider",
        raw_model_id="model",
        cwd="cwd",
        occurred_at=F.coalesce(F.col("occurred_at"), modified(rows)),
        fresh_input_tokens="fresh",
        cache_read_input_tokens="read",
        cache_write_input_tokens="write",
        cache_write_available="wrote",
        output_tokens="output",
        reasoning_output_tokens="reasoning",
        unattributed_tokens=F.greatest(F.lit(0), F.col("total") - known),
        cost_nano_usd="cost_nano",
    )
    return out.unionByName(quarantined(rows.where("broken")))


def context(rows: DataFrame) -> DataFrame:
    """The parsed lines that later ones depend on: the first header, the first that names a directory, and of every message its
    place in the graph alone."""
    rows = rows.where("NOT broken")
    marked = rows.where("header").withColumns({"opens": is_first(F.col("header"), ["file"]), "places": is_first(F.col("cwd").isNotNull(), ["file"])})
    heads = written(marked.where("opens OR places").select(*rows.columns), "heads")
    return alone(rows).join(heads.select("file", "ordinal"), ["file", "ordinal"], "left_anti").select(*rows.columns).unionByName(heads)


def pi(lines: DataFrame) -> DataFrame:
    """Records of lines (file, ordinal, text)."""
    return records(written(parsed(lines), "parsed"))
