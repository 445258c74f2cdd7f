"""The store: raw snapshots are appended, status and facts are derived from them.

Bronze keeps every record once; which snapshot of a request stands, and the dimensions, are functions of bronze, so a
rebuild is a read with another config. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_KEY = ["logical_session_id", "line_ordinal", "envelope_hash"]
REQUEST = ["source_id", "logical_session_id", "request_id"]
EVENT = ["harness", "logical_session_id", "request_id"]


def hashed(*keys: str) -> list[Column]:
    """Keys of a window after their hash: rows are sorted by a number, and texts that begin alike (paths, ids of one source) are
    compared among equals alone."""
    return [F.xxhash64(*keys), *map(F.col, keys)]


def new_records(incoming: DataFrame, bronze: DataFrame | None, *dealt: str) -> DataFrame:
    """Incoming records that bronze has not, the first of equal ones. The source is no part of the key: files move.

    dealt: columns that follow from the key, by which incoming is dealt into tasks already; without bronze it stays as it lies.
    """
    w = Window.partitionBy(*dealt, *hashed(*RAW_KEY)).orderBy("seq")
    fresh = incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    if bronze is None:
        return fresh
    held = bronze.select(*(F.col(c).alias(f"__{c}") for c in RAW_KEY))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in RAW_KEY]
    return fresh.join(held, same[0] & same[1] & same[2], "left_anti")


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(*hashed(*keys)).orderBy(F.desc(seq))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_status(bronze: DataFrame) -> DataFrame:
    """normalized for the last snapshot of a request in its source, duplicate for those it supersedes; quarantine stays."""
    usage = F.col("kind") == "usage"
    last = F.max(F.when(usage, F.col("seq"))).over(Window.partitionBy(*hashed(*REQUEST)))
    status = F.when(usage & (F.col("seq") < last), "duplicate").when(usage, "normalized").otherwise(F.col("kind"))
    return bronze.withColumns({"status": status, "superseded": usage & (F.col("seq") < last)})


def events(bronze: DataFrame, cutoff: str | None = None) -> DataFrame:
    """The records that become facts: the standing snapshots, last write wins across sources, from the cutoff on."""
    # Those that with_status calls normalized; of a rank, what is superseded goes before rows are shuffled.
    w = Window.partitionBy(*hashed(*REQUEST)).orderBy(F.desc("seq"))
    rows = bronze.where("kind = 'usage'").withColumn("__rank", F.rank().over(w)).where("__rank = 1").drop("__rank")
    rows = rows.where(F.col("occurred_at") >= F.lit(cutoff).cast("timestamp_ntz")) if cutoff else rows
    return latest(rows, EVENT)


def missing(catalogue: DataFrame, present: DataFrame) -> DataFrame:
    """Files of the catalogue that are there no more; their records stay."""
    return catalogue.join(present.select("file_id"), "file_id", "left_anti")


def without_source(bronze: DataFrame, source: str) -> DataFrame:
    return bronze.where(F.col("source_id") != source)


def cleared(table: DataFrame) -> DataFrame:
    """What is left of a table that is cleared: its columns without a row, for an overwrite. Facts are cleared alone for a
    renormalisation; bronze and its cursors as well for a rebuild."""
    return table.where(F.lit(False))


def projects(rows: DataFrame) -> DataFrame:
    """The path of a project as it was last written."""
    return rows.where("project_id is not null").groupBy("project_id").agg(F.max_by("path", "seq").alias("path"))


def sessions(rows: DataFrame) -> DataFrame:
    """Project and directory: the last that were known. First and last seen: the times of the first and last record as written."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    seen = [F.min_by("occurred_at", "seq").alias("first_seen"), F.max_by("occurred_at", "seq").alias("last_seen")]
    return rows.groupBy("session_id").agg(known("project_id"), known("cwd"), *seen)


def turns(rows: DataFrame) -> DataFrame:
    """A turn belongs to the session that named it first."""
    return rows.where("turn_id is not null").groupBy("turn_id").agg(F.min_by("session_id", "seq").alias("session_id"), F.min("occurred_at").alias("started_at"))


def providers(rows: DataFrame) -> DataFrame:
    raw = F.max_by("raw_provider_id", F.when(F.col("raw_provider_id").isNotNull(), F.col("seq"))).alias("raw_provider_id")
    return rows.where("canonical_provider_id is not null").groupBy("canonical_provider_id").agg(raw)


def models(rows: DataFrame) -> DataFrame:
    return rows.where("canonical_model_id is not null").groupBy("canonical_model_id").agg(F.max_by("raw_model_id", F.when(F.col("raw_model_id").isNotNull(), F.col("seq"))).alias("display"))


def counters(bronze: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Per source: files, records by status, and the events of its harness."""
    n = lambda test: F.count_if(test).alias
    status = with_status(bronze)
    raw = status.groupBy("source_id", "harness").agg(F.count("*").alias("raw_records"), n(F.col("status") == "quarantine")("quarantined"), n(F.col("status") == "duplicate")("duplicates"), n(F.col("status") == "normalized")("normalized"))
    own = files.groupBy("source_id").agg(F.count("*").alias("files"))
    by_harness = facts.groupBy("harness").agg(F.count("*").alias("harness_events"))
    zero: list[Column] = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "raw_records", "quarantined", "duplicates", "normalized", "harness_events")]
    return raw.join(own, "source_id", "full").join(F.broadcast(by_harness), "harness", "left").select("source_id", "harness", *zero)


def warnings(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Quarantined records and sources in error, as one number."""
    bad = sources.agg(F.coalesce(F.sum("quarantined"), F.lit(0)).alias("q"))
    errors = runs.agg(F.count_if(F.col("error").isNotNull()).alias("e"))
    return bad.crossJoin(errors).select((F.col("q") + F.col("e")).alias("warnings"))


RUN = "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, files long, imported long, duplicates long, quarantined long, error string"


def run_log(entries: DataFrame) -> DataFrame:
    """One row per run from the entries appended while it was under way.

    entries: run_id, seq, at, status (running, completed, failed), files, imported, duplicates, quarantined (of one step;
    null counts as 0) and error. Counters add up, errors are kept in order, and the last entry says how the run stands.
    """
    ended = F.col("status") != "running"
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("seq", "error")))), lambda e: e["error"])
    return entries.groupBy("run_id").agg(
        F.min("at").alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("finished_at"),
        F.max_by("status", "seq").alias("status"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files", "imported", "duplicates", "quarantined")),
        F.nullif(F.array_join(errors, "; "), F.lit("")).alias("error"),
    )


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
