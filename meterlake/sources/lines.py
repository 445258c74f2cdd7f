"""Finished lines of append-only logs, numbered per file.

Files are read in splits by Spark's text reader. A line's number is its place in the split plus the lines of the
splits before it, so no file has to pass through one task. A last line without a line feed is not finished and
waits for the next read: it shows in the sum of the lines' bytes, which is then one more than the file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.session import written

GLOBS = {"pi": "*.{jsonl,ndjson}", "codex": "*.{jsonl,ndjson,rollout}", "claude-code": "*.jsonl", "cursor": "*.jsonl"}


def finished_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """file, modified_at, ordinal (from 1) and text of each finished line; a carriage return at its end is dropped."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    m = F.col("_metadata")
    rows = read.select(
        m["file_path"].alias("file"),
        m["file_modification_time"].alias("modified_at"),
        m["file_size"].alias("size"),
        m["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )
    # Written first: numbers of rows hold within one read only.
    rows = written(rows, "lines")
    blocks = rows.groupBy("file", "block", "size").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    by_file = Window.partitionBy("file")
    before = F.sum("n").over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(by_file).alias("lines"), (F.sum("bytes").over(by_file) > F.col("size")).alias("open"))
    placed = rows.join(blocks, ["file", "block"]).withColumn("ordinal", F.col("before") + F.col("at") - F.col("first") + 1)
    placed = placed.where(~F.col("open") | (F.col("ordinal") < F.col("lines")))
    return placed.select("file", "modified_at", "ordinal", F.regexp_replace("text", r"\r$", "").alias("text"))


def unchanged(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that need no read: same path, size and time as before, read to the end, and not empty.

    files: path, size, modified_at. before: the same and cursor (bytes that were read).
    """
    known = before.select("path", F.col("size").alias("old_size"), F.col("modified_at").alias("old_time"), "cursor")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified_at") == F.col("old_time")) & (F.col("cursor") >= F.col("size")) & (F.col("size") > 0)
    return files.join(known, "path").where(same).select(*files.columns)


def fingerprint(lines: DataFrame, version: str, sample: int = 4, keys: int = 16) -> DataFrame:
    """file, fingerprint: a digest of the reader's version and the shape (sorted keys) of the first lines that are not blank."""
    first = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    some = lines.where(F.trim("text") != "").select("file", "ordinal", "text").withColumn("n", first).where(F.col("n") <= sample)
    kind = F.schema_of_variant(F.try_parse_json("text"))
    shape = F.when(kind.isNull(), "?").when(kind.startswith("OBJECT"), F.concat_ws(",", F.slice(F.array_sort(F.json_object_keys("text")), 1, keys))).otherwise(kind)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", shape.alias("shape")))), lambda x: x["shape"])
    return some.groupBy("file").agg(F.hex(F.xxhash64(F.concat_ws("|", F.lit(version), F.array_join(ordered, "|")))).alias("fingerprint"))


def logical_id(file: str = "file") -> Column:
    """The session that a path stands for: its base name, or session:subagent:name for a subagent's log."""
    name = F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]+$", "")
    parent = F.regexp_extract(file, r"([^/]+)/subagents/[^/]+$", 1)
    return F.when(parent != "", F.concat_ws(":subagent:", parent, name)).otherwise(name)
