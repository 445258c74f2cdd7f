"""The one shape of records that every reader gives, without any content of the conversation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.graph import first_nodes, nearest
from meterlake.session import written
from meterlake.sources.lines import logical_id

#: kind is usage, duplicate, quarantine (with a reason), or skipped for records that count nothing.
RECORD = """file string, ordinal long, kind string, reason string, logical_session_id string, request_id string, parent_id string, turn_id string,
raw_provider_id string, raw_model_id string, cwd string, occurred_at timestamp_ntz, fresh_input_tokens long, cache_read_input_tokens long,
cache_write_input_tokens long, cache_write_available boolean, output_tokens long, reasoning_output_tokens long, unattributed_tokens long, cost_nano_usd long,
flags array<string>, query_source string"""
FIELDS = [f.split() for f in RECORD.replace("\n", " ").split(", ")]


def shaped(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """The columns of RECORD; those that are not given are null, zero for counts."""

    def one(name: str, kind: str) -> Column:
        if name in columns:
            c = columns[name]
            return (F.col(c) if isinstance(c, str) else c).cast(kind).alias(name)
        optional = ("reasoning_output_tokens", "ordinal")
        return F.lit(0 if kind == "long" and name.endswith("tokens") and name not in optional else None).cast(kind).alias(name)

    return rows.select(*(one(*f) for f in FIELDS))


def malformed(text: str = "text") -> Column:
    """Whether a line is neither blank nor a JSON object."""
    return (F.trim(text) != "") & ~is_object(text)


def is_object(text: str) -> Column:
    """Whether a text is a JSON object: it is valid, and begins like one."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.col(text).rlike(r"^[ \t\r\n]*\{"), F.lit(False))


def filled(*values: Column) -> Column:
    """The first of these values that is not empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def strings(names: Iterable[str]) -> str:
    """A schema of strings: what is no string comes as its JSON text."""
    return ", ".join(f"{n} string" for n in names)


def quarantined(bad: DataFrame) -> DataFrame:
    """Records of malformed lines (file, ordinal), under the session of their file."""
    return shaped(bad, file="file", ordinal="ordinal", kind=F.lit("quarantine"), reason=F.lit("malformed-json"), logical_session_id=logical_id())


def with_malformed(lines: DataFrame, records: DataFrame) -> DataFrame:
    """The records, and a quarantined one for every line that is neither blank nor a JSON object."""
    return records.unionByName(quarantined(lines.where(malformed())))


def carrying(lines: DataFrame) -> list[str]:
    """What a parsed line keeps of the line: its place, and whatever else it is known by."""
    return [c for c in lines.columns if c != "text"]


def with_turns(rows: DataFrame, nodes: DataFrame, roles: tuple[str, ...], node: str = "node") -> DataFrame:
    """rows (file, ordinal, node) and turn_id: the nearest ancestor of one of the roles, itself included, as far as the log
    says so up to the row. nodes: file, ordinal, node, parent, role of every line; the first of a node counts."""
    first = first_nodes(nodes.where(F.col("node").isNotNull()).withColumnRenamed("file", "session"))
    found = nearest(first, roles).where(F.col("ancestor").isNotNull()).select(F.col("session").alias("file"), F.col("node").alias(node), F.col("ancestor").alias("turn_id"), "known_at")
    # Written, so that Spark knows its size before it deals all rows for the join.
    found = written(found, "turns")
    out = rows.join(found, ["file", node], "left")
    return out.withColumn("turn_id", F.when(F.col("known_at") <= F.col("ordinal"), F.col("turn_id"))).drop("known_at")


def graph_alone(rows: DataFrame, needed: Column) -> DataFrame:
    """The parsed lines that are needed, and the first of every other message with its place in the graph alone: what it said of
    usage, sessions and directories becomes null or false."""
    first = F.row_number().over(Window.partitionBy("file", "node").orderBy("ordinal")) == 1
    whole = F.coalesce(needed, F.lit(False))
    marked = rows.withColumns({"__whole": whole, "__first": F.col("node").isNotNull() & first}).where("__whole OR __first")
    kept = ("file", "ordinal", "node", "parent", "role")
    nothing = lambda kind: F.lit(False if kind == "boolean" else None).cast(kind)
    return marked.select(*(F.col(c) if c in kept else F.when(F.col("__whole"), F.col(c)).otherwise(nothing(kind)).alias(c) for c, kind in rows.dtypes))


def alone(rows: DataFrame) -> DataFrame:
    """The first parsed line of every message with its place in the graph alone, in the columns of rows."""
    kept = ("file", "ordinal", "node", "parent", "role")
    nothing = lambda kind: F.lit(False if kind == "boolean" else None).cast(kind)
    first = first_nodes(rows.where(F.col("node").isNotNull()).select(*kept).withColumnRenamed("file", "session")).withColumnRenamed("session", "file")
    return first.select(*(F.col(c) if c in kept else nothing(kind).alias(c) for c, kind in rows.dtypes))


def modified(lines: DataFrame) -> Column:
    """When a line's file was last written, if the lines know."""
    return F.col("modified_at").cast("timestamp_ntz") if "modified_at" in lines.columns else F.lit(None).cast("timestamp_ntz")


def instant(text: Column) -> Column:
    """UTC time of an ISO string; null if it is none."""
    return F.to_timestamp_ntz(F.rtrim(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z?$"), text), F.lit("Z")))
