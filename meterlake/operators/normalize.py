"""From records to facts: identity, privacy guard, flags, canonical dimensions, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import canonical
from meterlake.functions.config import Config
from meterlake.operators import store
from meterlake.sources.cursor import spool_order
from meterlake.sources.lines import logical_id

# Keys that hold content of a conversation.
FORBIDDEN = (
    "prompt prompts content text input output tool_input tool_output tool_name tool_result tool_use function_call tool_calls messages body snippet code "
    "email user_email transcript transcript_path attachment attachments thinking reasoning_text response responses"
).split()
#: Containers around a key up to which it is looked at.
DEPTH = 7
# Flags that a reader may set.
READER_FLAGS = ("missing-cache-read", "approximate-timestamp", "historical-partial-accounting", "cursor-token-fields-missing", "multi-root-project-ambiguous", "cursor-input-semantics-unverified")

# A string that is not empty; a forbidden key once strings are marks.
_STRING = r'"(?:[^"\\]|\\.)+"'
_KEY = rf'"(?i:{"|".join(FORBIDDEN)})"\s*:@'


def holds_content(json: Column | str) -> Column:
    """Whether a JSON text has one of the FORBIDDEN keys with a non-empty string, an object or an array, not too deep.

    Only structure is kept: empty strings go, other strings become a mark, and of the keys the forbidden ones stay. A
    key's depth is the number of containers opened before it.
    """
    json = F.col(json) if isinstance(json, str) else json
    bare = F.regexp_replace(json, f'({_STRING})|""', "$1")
    bare = F.regexp_replace(bare, rf"({_STRING}\s*:)|{_STRING}", "$1@")
    bare = F.regexp_replace(bare, rf"({_KEY})|{_STRING}\s*:@", "$1")
    opened = lambda s: F.length(F.regexp_replace(s, r"[^\[{]", "")) - F.length(F.regexp_replace(s, r"[^\]}]", ""))
    pieces = F.split(bare, rf"{_KEY}\s*(?=[@\[{{])", -1)
    before = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    walk = F.aggregate(
        before,
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found")),
        lambda acc, s: F.struct((acc["depth"] + opened(s)).alias("depth"), (acc["found"] | (acc["depth"] + opened(s) <= DEPTH)).alias("found")),
        lambda acc: acc["found"],
    )
    return F.coalesce(walk, F.lit(False))


def guarded(records: DataFrame, context: str) -> DataFrame:
    """Records whose context (JSON) holds content are quarantined; the context itself goes no further."""
    bad = (F.col("kind") == "usage") & holds_content(context)
    return records.withColumns({"reason": F.when(bad, "forbidden-content-detected").otherwise(F.col("reason")), "kind": F.when(bad, "quarantine").otherwise(F.col("kind"))}).drop(context)


def envelope_hash(rows: DataFrame, columns: list[str]) -> Column:
    """32 hexadecimal digits of a digest of the columns, whatever their order in rows; null is not the empty string."""
    names = sorted(columns)
    return F.substring(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), 1, 32)


def quality_flags(cache_write: Column, reasoning: Column, cost: Column, own: Column) -> Column:
    """What is not known, then the reader's flags that are allowed, each once."""
    missing = F.array_compact(F.array(F.when(~cache_write, F.lit("missing-cache-write")), F.when(~reasoning, F.lit("missing-reasoning")), F.when(~cost, F.lit("missing-cost"))))
    allowed = F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda f: f.isin(*READER_FLAGS))
    return F.array_distinct(F.concat(missing, allowed))


ENVELOPE = ["harness", "kind", "reason", "logical_session_id", "request_id", "line_ordinal", "occurred_at", "turn_id", "raw_provider_id", "raw_model_id", "cwd", "parent_id"] + [
    "fresh_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "cache_write_available", "output_tokens", "reasoning_output_tokens", "unattributed_tokens", "cost_nano_usd"
]


def raw(records: DataFrame, harness: str, source: str, commit: int = 0) -> DataFrame:
    """Records of a reader as rows of bronze: harness, source, identity and the order in which they were written.

    Every record has a session, its file's where the reader knows none. The order of writing: by commit, within one by file
    (of spools, imported history first), then by line.
    """
    session = F.coalesce("logical_session_id", logical_id(), F.lit("unknown"))
    rows = records.where("kind <> 'skipped'").withColumns({"harness": F.lit(harness), "source_id": F.lit(source), "line_ordinal": F.col("ordinal"), "logical_session_id": session})
    rows = rows.withColumn("envelope_hash", envelope_hash(rows, ENVELOPE))
    place = F.struct(F.lit(commit).cast("long").alias("commit"), spool_order().alias("spool"), F.col("line_ordinal"))
    return rows.withColumn("seq", place)


def facts(bronze: DataFrame, config: Config = Config()) -> DataFrame:
    """usage_events from bronze: the standing snapshot of each request, under the config of today.

    A project is named by the root of its repository where bronze has it, else by the directory.
    """
    rows = store.events(bronze, config.cutoff)
    got = canonical.resolved(F.col("harness"), F.col("raw_provider_id"), F.col("raw_model_id"), F.col("occurred_at"), config)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    inputs = n("fresh_input_tokens") + n("cache_read_input_tokens") + n("cache_write_input_tokens")
    written = F.coalesce(F.col("cache_write_available"), F.lit(False))
    folder = F.coalesce("root", "cwd") if "root" in rows.columns else F.col("cwd")
    session = F.concat_ws(":", "harness", "logical_session_id")
    return rows.select(
        canonical.hash_id("event", F.concat_ws(":", "harness", "logical_session_id", "request_id")).alias("id"),
        F.lit(None).cast("long").alias("raw_record_id"),
        "harness",
        "occurred_at",
        session.alias("session_id"),
        "logical_session_id",
        "turn_id",
        "request_id",
        canonical.project_id(folder, config).alias("project_id"),
        "raw_provider_id",
        got["canonical_provider_id"].alias("canonical_provider_id"),
        got["provider_resolution"].alias("provider_resolution"),
        "raw_model_id",
        got["canonical_model_id"].alias("canonical_model_id"),
        inputs.alias("processed_input_tokens"),
        *(n(c).alias(c) for c in ("fresh_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens")),
        written.alias("cache_write_available"),
        n("output_tokens").alias("output_tokens"),
        "reasoning_output_tokens",
        n("unattributed_tokens").alias("unattributed_tokens"),
        (inputs + n("output_tokens") + n("unattributed_tokens")).alias("processed_tokens"),
        "cost_nano_usd",
        F.col("cost_nano_usd").isNotNull().alias("cost_available"),
        quality_flags(written, F.col("reasoning_output_tokens").isNotNull(), F.col("cost_nano_usd").isNotNull(), F.col("flags")).alias("quality_flags"),
    )


def routed(records: DataFrame) -> DataFrame:
    """What became of the records of each file: imported, duplicates, quarantined."""
    n = lambda kind: F.count_if(F.col("kind") == kind).cast("long")
    return records.groupBy("file").agg(n("usage").alias("imported"), n("duplicate").alias("duplicates"), n("quarantine").alias("quarantined"))
