"""Usage events of an editor's stop hook, spooled as lines, and what its older key-value store still holds."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators.ingest import safe
from meterlake.session import written
from meterlake.sources import sqlite
from meterlake.sources.records import carrying, filled, malformed, quarantined, shaped, strings

# The format of spooled events, whichever producer comes first in its tag, and a flag.
FORMAT, AMBIGUOUS = r"^[a-z]+\.cursor\.usage\.v1$", "multi-root-project-ambiguous"
MANIFEST, NO_WORKSPACE = "workspace.json", "empty-window"
SCHEMA = "meterlake.cursor.usage.v1"
COUNTERS = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens")
STATES = ("completed", "aborted", "error")
EVENT = """schema string, source string, receivedAt string, conversationId string, generationId string, cursorVersion string, modelId string, legacyModel string,
workspaceRoot string, status string, inputTokens long, outputTokens long, cacheReadTokens long, cacheWriteTokens long, reasoningTokens long, occurredAt string, timestampConfidence string, flags array<string>"""
#: What is read of a value of the older store.
BUBBLE = "type string, usageUuid string, modelInfo struct<modelName:string>, tokenCount struct<inputTokens:string,outputTokens:string>, timingInfo struct<clientRpcSendTime:string>"
NAMES = [x.split()[0] for x in EVENT.replace("\n", " ").split(", ")]


def _text(json: str, *names: str) -> Column:
    """The first of these fields that is there, if it is a string that is not empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names))


def _counter(json: str, *names: str) -> Column:
    return safe(F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names)).try_cast("double"))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _instant(x: Column) -> Column:
    """UTC time of an ISO string or of milliseconds; null for anything else."""
    number = x.try_cast("double")
    iso = F.when(x.rlike(r"^\d{4}-\d\d-\d\d"), F.expr("0")).isNotNull()
    return F.when(number > 0, F.timestamp_millis(number.cast("long"))).when(iso, F.try_to_timestamp(x))


def _iso(x: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sanitised(payloads: DataFrame, project_dir: str | None = None) -> DataFrame:
    """Events (EVENT) from hook payloads: only the fields that are listed here, nothing else of a payload goes further.

    payloads: raw (JSON), received_at (ISO). Fields may be spelled with underscores or in camel case. The workspace is
    project_dir, else the one root; several roots are ambiguous and leave a flag. Without both identities there is no event.
    """
    both = lambda n: (n, _camel(n))
    roots = F.filter(F.coalesce(F.from_json(F.get_json_object("raw", "$.workspace_roots"), "array<string>"), F.array().cast("array<string>")), lambda r: F.coalesce(r, F.lit("")) != "")
    single = F.get_json_object("raw", "$.workspace_root")
    one = F.coalesce(F.lit(project_dir).cast("string"), F.when(~single.startswith("["), F.nullif(single, F.lit(""))))
    exact = _instant(F.coalesce(*(F.get_json_object("raw", f"$.{n}") for n in ("occurred_at", "occurredAt", "timestamp"))))
    status = _text("raw", "status")
    rows = payloads.select(
        F.lit(SCHEMA).alias("schema"),
        F.lit("stop-hook").alias("source"),
        F.col("received_at").alias("receivedAt"),
        _text("raw", *both("conversation_id")).alias("conversationId"),
        _text("raw", *both("generation_id")).alias("generationId"),
        _text("raw", *both("cursor_version")).alias("cursorVersion"),
        _text("raw", *both("model_id")).alias("modelId"),
        _text("raw", "model").alias("legacyModel"),
        F.coalesce(one, F.when(F.size(roots) == 1, roots[0])).alias("workspaceRoot"),
        F.when(status.isin(*STATES), status).alias("status"),
        *(_counter("raw", *both(n)).alias(_camel(n)) for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")),
        F.coalesce(_iso(exact), F.col("received_at")).alias("occurredAt"),
        F.when(exact.isNotNull(), "exact").otherwise("hook-receipt").alias("timestampConfidence"),
        F.when(one.isNull() & (F.size(roots) > 1), F.array(F.lit(AMBIGUOUS))).alias("flags"),
    )
    return rows.where("conversationId IS NOT NULL AND generationId IS NOT NULL")


def parsed(lines: DataFrame) -> DataFrame:
    """What the records take from spooled lines (file, ordinal, text): counters and identities are validated again.

    Events without any counter are quarantined, those with zeros alone are no request. The input of live events may or may
    not include cached tokens, which a flag says.
    """
    # Each line is parsed once.
    event = F.col("__event")
    given = {c: event[c] for c in COUNTERS}
    value = {c: safe(x.try_cast("double")) for c, x in given.items()}
    broken = F.lit(False)
    for c in COUNTERS:
        broken = broken | (given[c].isNotNull() & value[c].isNull())
    rows = lines.where("text IS NULL OR trim(text) <> ''").withColumns({"bad": malformed(), "__event": F.from_json("text", strings(NAMES))}).withColumns(
        {c: x for c, x in value.items()} | {"broken": broken, "conversation": filled(event["conversationId"]), "generation": filled(event["generationId"]), "source": F.coalesce(event["source"], F.lit(""))}
    )
    counts = [F.col(c) for c in COUNTERS[:4]]
    tokenless = F.coalesce(*counts).isNull()
    zero = F.greatest(*counts, F.lit(0)) == 0
    identity = F.col("conversation").isNotNull() & F.col("generation").isNotNull()
    reason = (
        F.when(~F.rlike(F.coalesce(event["schema"], F.lit("")), F.lit(FORMAT)), "unknown-schema")
        .when(F.col("broken"), "invalid-token-value")
        .when(~identity, "malformed-json")
        .when(tokenless, "cursor-token-fields-missing")
    )
    legacy = F.col("source") == "legacy-backfill"
    own = F.coalesce(F.from_json(event["flags"], "array<string>"), F.array().cast("array<string>"))
    flags = F.array_compact(
        F.array(
            F.when(F.array_contains(own, AMBIGUOUS), F.lit(AMBIGUOUS)),
            F.when(~legacy, F.lit("cursor-input-semantics-unverified")),
            F.when(legacy, F.lit("historical-partial-accounting")),
            F.when(legacy & (F.coalesce(event["timestampConfidence"], F.lit("")) != "exact"), F.lit("approximate-timestamp")),
            F.when(F.col("cacheReadTokens").isNull(), F.lit("missing-cache-read")),
        )
    )
    return rows.select(
        *carrying(lines),
        F.col("bad").alias("broken"),
        F.when(reason.isNotNull(), "quarantine").when(zero, "skipped").otherwise("usage").alias("kind"),
        reason.alias("reason"),
        "conversation",
        "generation",
        filled(event["modelId"], event["legacyModel"]).alias("model"),
        filled(event["workspaceRoot"]).alias("cwd"),
        _instant(event["occurredAt"]).cast("timestamp_ntz").alias("occurred_at"),
        *COUNTERS,
        flags.alias("flags"),
    )


def records(rows: DataFrame) -> DataFrame:
    """Records of parsed events; no event depends on another."""
    out = shaped(
        rows.where("NOT broken"),
        file="file",
        ordinal="ordinal",
        kind="kind",
        reason="reason",
        logical_session_id="conversation",
        request_id="generation",
        turn_id="generation",
        raw_model_id="model",
        cwd="cwd",
        occurred_at="occurred_at",
        fresh_input_tokens=F.coalesce("inputTokens", F.lit(0)),
        cache_read_input_tokens=F.coalesce("cacheReadTokens", F.lit(0)),
        cache_write_input_tokens=F.coalesce("cacheWriteTokens", F.lit(0)),
        cache_write_available=F.col("cacheWriteTokens").isNotNull(),
        output_tokens="outputTokens",
        reasoning_output_tokens="reasoningTokens",
        flags="flags",
    )
    return out.unionByName(quarantined(rows.where("broken")))


def context(rows: DataFrame) -> DataFrame:
    return rows.where(F.lit(False))


def cursor(lines: DataFrame) -> DataFrame:
    """Records of spooled lines (file, ordinal, text)."""
    return records(written(parsed(lines), "parsed"))


# The older store: cursorDiskKV(key, value) as sqlite.KeyValues reads it.


def bubbles(rows: DataFrame) -> DataFrame:
    """composer, bubble, and either a user's model or a request's counters, of keys bubbleId:<composer>:<bubble>."""
    parts = F.split("key", ":")
    value = F.col("__value")
    user = value["type"] == "1"
    model = filled(value["modelInfo"]["modelName"])
    out = rows.where(F.col("key").startswith("bubbleId:") & (F.size(parts) == 3)).withColumn("__value", F.from_json("value", BUBBLE)).select(
        parts[1].alias("composer"),
        parts[2].alias("bubble"),
        F.coalesce(user, F.lit(False)).alias("user"),
        F.when(user & (model != "default"), model).alias("model"),
        filled(value["usageUuid"]).alias("usage_id"),
        safe(value["tokenCount"]["inputTokens"].try_cast("double")).alias("input"),
        safe(value["tokenCount"]["outputTokens"].try_cast("double")).alias("output"),
        value["timingInfo"]["clientRpcSendTime"].try_cast("double").alias("time_ms"),
        "key",
    )
    request = ~F.col("user") & F.col("usage_id").isNotNull() & (F.col("input") + F.col("output") > 0)
    # Written before it is filtered: a filter on what is parsed would be moved below the parsing and parse again.
    return written(out, "bubbles").where((F.col("composer") != "") & (F.col("bubble") != "") & (request | (F.col("user") & F.col("model").isNotNull())))


def attributed(found: DataFrame, composers: DataFrame) -> DataFrame:
    """The requests of bubbles() with the model that the user chose last before them, in the order of the conversation.

    composers: key composerData:<composer>, value with fullConversationHeadersOnly. A request out of every order has no model.
    """
    headers = F.from_json(F.get_json_object("value", "$.fullConversationHeadersOnly"), "array<struct<bubbleId:string>>")
    order = composers.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer"), F.posexplode(headers).alias("place", "header"))
    order = order.select("composer", "place", F.col("header.bubbleId").alias("bubble")).where("bubble IS NOT NULL")
    placed = order.join(found.select("composer", "bubble", "user", "model"), ["composer", "bubble"], "left")
    so_far = Window.partitionBy("composer").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    models = placed.withColumn("chosen", F.last(F.when(F.col("user"), F.col("model")), ignorenulls=True).over(so_far))
    # The first place at which a request has a model counts.
    models = models.where("NOT user AND chosen IS NOT NULL").groupBy("composer", "bubble").agg(F.min_by("chosen", "place").alias("chosen"))
    return found.where("NOT user").drop("model", "user").join(models, ["composer", "bubble"], "left").withColumnRenamed("chosen", "model")


def resolved_duplicates(requests: DataFrame) -> DataFrame:
    """One snapshot of each usage_id: the last of equal ones; by time if all have one and counters grow with it; without
    times the largest if one is the largest in both; otherwise kept is false and the identity is quarantined."""
    own = Window.partitionBy("usage_id")
    facts = {
        "n_vectors": F.size(F.collect_set(F.struct("input", "output")).over(own)),
        "timed": F.min(F.col("time_ms").isNotNull()).over(own),
    }
    rows = requests.withColumns(facts)
    by_time, by_size = own.orderBy("time_ms", "key"), own.orderBy("input", "output", "key")
    grows = lambda w: F.coalesce((F.col("input") >= F.lag("input").over(w)) & (F.col("output") >= F.lag("output").over(w)), F.lit(True))
    rows = rows.withColumns({"in_time": grows(by_time), "in_size": grows(by_size)})
    rows = rows.withColumns({"in_time": F.min("in_time").over(own), "in_size": F.min("in_size").over(own)})
    same = F.col("n_vectors") == 1
    place = F.when(same, F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("key").alias("c")))
    place = place.when(F.col("timed"), F.struct(F.col("time_ms").alias("a"), F.lit(0).cast("long").alias("b"), F.col("key").alias("c")))
    place = place.otherwise(F.struct(F.col("input").cast("double").alias("a"), F.col("output").alias("b"), F.col("key").alias("c")))
    rows = rows.withColumns({"place": place, "kept": same | F.when(F.col("timed"), F.col("in_time")).otherwise(F.col("in_size"))})
    last = F.row_number().over(own.orderBy(F.desc("place")))
    return rows.withColumn("rn", last).where("rn = 1").select("usage_id", "composer", "bubble", "input", "output", "time_ms", "model", "kept")


def folder_of(uri: Column) -> Column:
    """The path of a file URI, a drive without the slash before it."""
    path = F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file://[^/]*", ""), r"\+", "%2B"))
    return F.when(uri.startswith("file://"), F.nullif(F.translate(F.regexp_replace(path, r"^/([A-Za-z]):", "$1:"), "\\", "/"), F.lit("")))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """workspace and manifest (JSON) of each <folder>/<workspace>/workspace.json; none where there is no such file or folder."""
    try:
        read = spark.read.option("wholetext", "true").text(f"{folder}/*/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "workspace string, manifest string")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return read.select(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("workspace"), F.col("value").alias("manifest"))


def backlog(spark: SparkSession, database: str, workspace_storage: str, received_at: str) -> tuple[DataFrame, DataFrame]:
    """What an editor's older store still holds: events (EVENT), and one row that tells what became of its requests.

    The row has status (no-database, no-table, completed), bubbles (all that were looked at), positive (requests with tokens),
    identities, imported, quarantined (identities whose snapshots contradict each other), exact (with a time of their own) and
    with_model. database and workspace_storage are where the session's tasks can read them.
    """
    for source in (sqlite.KeyValues, sqlite.Headers):
        spark.dataSource.register(source)
    status = sqlite.state(database, "cursorDiskKV")
    if status == "ready":
        read = lambda prefix: spark.read.format("sqlite_keys").option("prefix", prefix).load(database)
        # The store may be in use: one read of it stands for all counts and events.
        rows, composers = written(read("bubbleId:"), "bubbles"), written(read("composerData:"), "composers")
        headers = written(spark.read.format("sqlite_headers").load(database), "headers")
    else:
        rows = composers = spark.createDataFrame([], sqlite.KEY_VALUES)
        headers = spark.createDataFrame([], sqlite.HEADERS)
    requests = attributed(bubbles(rows), composers)
    resolved = written(resolved_duplicates(requests), "resolved")
    events = legacy_events(resolved, composers, headers, manifests(spark, workspace_storage), received_at)
    kept = F.count_if("kept")
    told = resolved.agg(
        F.count("*").alias("identities"),
        kept.alias("imported"),
        F.count_if(~F.col("kept")).alias("quarantined"),
        F.count_if(F.col("kept") & F.col("time_ms").isNotNull()).alias("exact"),
        F.count_if(F.col("kept") & F.col("model").isNotNull()).alias("with_model"),
    )
    looked = rows.agg(F.count("*").alias("bubbles")).join(requests.agg(F.count("*").alias("positive")))
    return events, looked.join(told).select(F.lit("completed" if status == "ready" else status).alias("status"), "*")


def legacy_events(requests: DataFrame, composers: DataFrame, headers: DataFrame, workspaces: DataFrame, received_at: str) -> DataFrame:
    """Events (EVENT) of resolved requests; times without an own one are those of the conversation, or of the reading.

    composers: key, value (createdAt); headers: composer, workspace, created_ms; workspaces: workspace, manifest (JSON with folder).
    """
    workspaces = workspaces.where(F.col("workspace") != NO_WORKSPACE)
    known = headers.join(workspaces.select("workspace", folder_of(F.get_json_object("manifest", "$.folder")).alias("folder")), "workspace", "left").select("composer", "created_ms", "folder")
    rest = composers.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer"), F.get_json_object("value", "$.createdAt").try_cast("double").cast("long").alias("created_ms"), F.lit(None).cast("string").alias("folder"))
    places = known.unionByName(rest.join(known, "composer", "left_anti")).dropDuplicates(["composer"])
    rows = requests.where("kept").join(places, "composer", "left")
    at = F.coalesce(F.col("time_ms").cast("long"), F.col("created_ms"))
    null = lambda kind: F.lit(None).cast(kind)
    columns = {
        "schema": F.lit(SCHEMA), "source": F.lit("legacy-backfill"), "receivedAt": F.lit(received_at), "conversationId": F.col("composer"), "generationId": F.col("usage_id"), "cursorVersion": null("string"),
        "modelId": F.col("model"), "legacyModel": null("string"), "workspaceRoot": F.col("folder"), "status": null("string"), "inputTokens": F.col("input"), "outputTokens": F.col("output"),
        "cacheReadTokens": null("long"), "cacheWriteTokens": null("long"), "reasoningTokens": null("long"), "occurredAt": F.coalesce(_iso(F.timestamp_millis(at)), F.lit(received_at)),
        "timestampConfidence": F.when(F.col("time_ms").isNotNull(), "exact").otherwise("approximate"), "flags": null("array<string>"),
    }
    return rows.select(*(columns[n].alias(n) for n in NAMES))


def write_spool(events: DataFrame, folder: str) -> str:
    """The events as one file named by its content, which replaces the spools of earlier contents. The path of the file.

    For the backlog of one editor's store, on the machine that has it: its events are read one by one, in order.
    """
    into = Path(folder)
    into.mkdir(parents=True, exist_ok=True)
    part, digest = into / f"legacy.part-{os.getpid()}", hashlib.sha256()
    lines = events.orderBy("occurredAt", "generationId").select(F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"}).alias("line"))
    with part.open("w", encoding="utf-8") as out:
        for row in lines.toLocalIterator():
            out.write(row["line"] + "\n")
            digest.update(row["line"].encode() + b"\n")
    path = into / f"legacy-{digest.hexdigest()[:16]}.jsonl"
    os.replace(part, path)
    for other in into.glob("legacy*.jsonl"):
        if other != path:
            other.unlink()
    return str(path)


def spool_order(file: str = "file") -> Column:
    """Imported history comes before live events, each by path, so that what is live is stored last."""
    return F.struct(F.when(F.contains(F.col(file), F.lit("/backfill/import/")), 0).otherwise(1).alias("rank"), F.col(file).alias("path"))
