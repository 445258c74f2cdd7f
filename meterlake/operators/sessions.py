"""Sessions: lists with search and pages, details, the largest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import canonical
from meterlake.functions.config import Config
from meterlake.functions.metrics import costed, processed_of_parts, ratio, to_usd
from meterlake.operators.events import read
from meterlake.operators.filters import Filters, apply, like_text

SORTS = ("recent", "tokens", "cost", "requests", "project", "harness", "cache")
PAGE, MOST = 25, 100
BUCKETS = 48


def stored_model() -> Column:
    return F.coalesce("canonical_model_id", "raw_model_id", F.lit("unknown-model"))


def read_model() -> Column:
    return F.coalesce(canonical.canonical_model(stored_model()), stored_model())


def models_of() -> Column:
    """The models of a group of events at read time; ids are made canonical once per group."""
    read = F.transform(F.collect_set(stored_model()), lambda m: F.coalesce(canonical.canonical_model(m), m))
    return F.array_join(F.array_sort(F.array_distinct(read)), ",")


def measures() -> list[Column]:
    """What every view of a session counts."""
    parts, cost = processed_of_parts(), costed()
    n = lambda test: F.count_if(test).cast("long")
    return [
        F.min("occurred_at").alias("first_activity"),
        F.max("occurred_at").alias("last_activity"),
        F.count("*").alias("requests"),
        F.countDistinct("turn_id").alias("turns"),
        n(F.col("turn_id").isNotNull()).alias("attributed_requests"),
        F.sum(parts).alias("processed_tokens"),
        *(F.sum(c).alias(c) for c in ("processed_input_tokens", "fresh_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "output_tokens")),
        F.sum(F.coalesce("reasoning_output_tokens", F.lit(0))).alias("reasoning_output_tokens"),
        n(F.col("reasoning_output_tokens").isNotNull()).alias("reasoning_available"),
        n(F.col("cache_write_available")).alias("cache_write_available"),
        F.sum("unattributed_tokens").alias("unattributed_tokens"),
        F.sum(cost).alias("cost_nano"),
        n(cost.isNotNull()).alias("cost_available"),
        F.sum(F.when(cost.isNotNull(), parts).otherwise(0)).alias("costed_tokens"),
    ]


def rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "cost_usd": to_usd("cost_nano"),
            "cost_coverage": ratio("costed_tokens", "processed_tokens"),
            "cache_hit_rate": ratio("cache_read_input_tokens", "processed_input_tokens"),
        }
    ).drop("costed_tokens")


def listed(events: DataFrame, projects: DataFrame, f: Filters = Filters(), search: str = "") -> DataFrame:
    """All sessions that match; a search hit on any project or model keeps the whole session."""
    known = projects.select("project_id", "display_path")
    rows = apply(events, f).where("session_id is not null").join(known, "project_id", "left")
    hit = F.max(like_text(F.coalesce("display_path", F.lit("")), search) | like_text(F.coalesce("canonical_model_id", "raw_model_id", F.lit("")), search)).alias("hit")
    agg = rows.groupBy("session_id").agg(
        F.min("harness").alias("harness"),
        F.min("project_id").alias("project_id"),
        F.min("display_path").alias("project_path"),
        models_of().alias("models"),
        hit,
        *measures(),
    )
    agg = agg.where(F.col("hit") | like_text(F.col("session_id"), search)) if search else agg
    return rates(agg.drop("hit").withColumn("project_name", canonical.project_name("project_path")))


def sort_key(sort: str) -> Column:
    keys = {
        "recent": F.col("last_activity"),
        "tokens": F.col("processed_tokens"),
        "cost": F.col("cost_nano"),
        "requests": F.col("requests"),
        "project": F.lower("project_name"),
        "harness": F.lower("harness"),
        "cache": F.col("cache_hit_rate"),
    }
    return keys.get(sort, keys["recent"])


def page(sessions: DataFrame, sort: str = "recent", number: int = 1, size: int = PAGE, order: str = "desc", total: int | None = None) -> DataFrame:
    """A page of listed(); a number beyond the last page is the last page, for which the total is counted if not given."""
    size = min(MOST, max(1, int(size)))
    number = max(1, int(number))
    if number > 1:
        total = sessions.count() if total is None else total
        number = min(number, max(1, -(-total // size)))
    key = sort_key(sort)
    ways = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
    return sessions.orderBy(ways, F.col("session_id").asc()).offset((number - 1) * size).limit(size)


def largest(events: DataFrame, f: Filters = Filters(), limit: int = 5) -> DataFrame:
    """The sessions with most tokens, their dominant model and their first project. Costs count whether or not available."""
    rows = apply(events, f)
    parts = processed_of_parts()
    per = rows.groupBy("session_id").agg(
        F.min("occurred_at").alias("started_at"),
        F.sum(parts).alias("processed_tokens"),
        F.sum("cost_nano_usd").alias("cost_nano"),
        F.count("*").alias("events"),
        F.max("harness").alias("harness"),
        F.min_by(F.struct("project_id"), F.struct("occurred_at", "id")).alias("project"),
    )
    # Only the few largest look for their dominant model.
    top = per.orderBy(F.desc("processed_tokens"), "session_id").limit(min(max(1, limit or 5), 25))
    weights = rows.join(F.broadcast(top.select("session_id")), "session_id", "left_semi").groupBy("session_id", stored_model().alias("model")).agg(F.sum(parts).alias("w"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("w"), "model"))
    dominant = weights.withColumn("rn", first).where("rn = 1").select("session_id", "model")
    return top.join(dominant, "session_id", "left").select("session_id", "started_at", "harness", F.coalesce("model", F.lit("unknown-model")).alias("model"), F.col("project.project_id").alias("project_id"), "events", "processed_tokens", to_usd("cost_nano").alias("cost_usd"))


def detail(events: DataFrame, projects: DataFrame, session: str, f: Filters = Filters(), config: Config = Config()) -> dict[str, DataFrame]:
    """The five parts of a session's view, each with the filter of one session at its scan; all empty for a session without events."""
    own = apply(events, f.but(session=session))
    return {"session": listed(own, projects), "models": model_usage(own, config), "timeline": timeline(own), "requests": largest_requests(own), "flags": flags(own)}


def model_usage(own: DataFrame, config: Config = Config()) -> DataFrame:
    """Per model and provider at read time; turns are distinct over all stored spellings."""
    provider = F.coalesce("canonical_provider_id", "raw_provider_id", F.lit("Unknown"))
    rows = own.withColumns({"model": read_model(), "provider": F.coalesce(canonical.canonical_provider(provider), provider)})
    modes: dict[str, str] = {}
    for name, mode in config.billing:
        modes.setdefault(canonical.PROVIDER_ROUTES.get(name.strip().lower(), name.strip().lower()), mode)
    return rates(rows.groupBy("session_id", "model", "provider").agg(*measures())).withColumn("billing_mode", canonical.choose(F.col("provider"), modes, F.lit("unspecified")))


def timeline(own: DataFrame) -> DataFrame:
    """At most BUCKETS buckets of equal seconds from the first to the last event of each session."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bounds = own.groupBy("session_id").agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    span = micros("hi") / 1e6 - seconds("lo") + 1
    bounds = bounds.select("session_id", seconds("lo").alias("start"), F.greatest(F.lit(1), F.ceil(span / BUCKETS)).cast("long").alias("width"))
    rows = own.join(bounds, "session_id").withColumn("bucket", F.expr("(unix_seconds(cast(occurred_at as timestamp)) - start) div width"))
    return rows.groupBy("session_id", "bucket", F.col("width").alias("bucket_seconds")).agg(
        F.min("occurred_at").alias("occurred_at"), F.sum(processed_of_parts()).alias("processed_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("requests")
    )


def largest_requests(own: DataFrame, limit: int = 5) -> DataFrame:
    return read(own.withColumn("processed", processed_of_parts()).orderBy(F.desc("processed"), "occurred_at", "id").limit(limit))


def flags(own: DataFrame) -> DataFrame:
    return own.select(F.explode("quality_flags").alias("flag")).distinct()
