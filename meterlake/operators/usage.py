"""Summaries, time series, models, attribution, dimensions: queries over filtered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import canonical
from meterlake.functions.config import Config
from meterlake.functions.metrics import costed, metric, ratio, requests, to_usd, total
from meterlake.operators.filters import Filters, apply, moment

NONE = Filters()


def _count_if(test: Column) -> Column:
    return F.coalesce(F.count_if(test), F.lit(0)).cast("long")


def summary(events: DataFrame, f: Filters = NONE, by: dict[str, Column] | None = None) -> DataFrame:
    """Totals, ratios and coverage, over everything or for each value of by. One row for no events, if not grouped.

    Distinct sessions and turns are counted over distinct (session, turn) rows, so the tokens are summed once and
    not expanded for each distinct count.
    """
    names = list(by or {})
    rows = apply(events, f).withColumns(by or {})
    cw, cost, weight = F.col("cache_write_available"), F.col("cost_available"), requests(rows)
    sums = {
        "processed_tokens": F.col("processed_tokens"),
        "processed_input_tokens": F.col("processed_input_tokens"),
        "fresh_input_tokens": F.col("fresh_input_tokens"),
        "cache_read_input_tokens": F.col("cache_read_input_tokens"),
        "cache_write_input_tokens": F.col("cache_write_input_tokens"),
        "output_tokens": F.col("output_tokens"),
        "reasoning_output_tokens": F.col("reasoning_output_tokens"),
        "unattributed_tokens": F.col("unattributed_tokens"),
        "cost_nano": costed(),
        "costed_tokens": F.when(cost, F.col("processed_tokens")),
        "cw_read": F.when(cw, F.col("cache_read_input_tokens")),
        "cw_write": F.when(cw, F.col("cache_write_input_tokens")),
        "requests": weight,
        "reasoning_available": F.when(F.col("reasoning_output_tokens").isNotNull(), weight),
        "cache_write_available": F.when(cw, weight),
        "cost_available": F.when(cost, weight),
    }
    # (session, turn) is the grain on which both distinct counts are cheap.
    grain = rows.groupBy(*names, "session_id", "turn_id").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    agg = grain.groupBy(*names).agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("turn_id").alias("turns"), *(total(k).alias(k) for k in sums))
    return agg.select(
        *names,
        *[k for k in sums if k not in ("cost_nano", "costed_tokens", "cw_read", "cw_write")],
        "sessions",
        "turns",
        to_usd("cost_nano").alias("cost_usd"),
        ratio("cache_read_input_tokens", "processed_input_tokens").alias("cache_hit_rate"),
        F.when((F.col("requests") > 0) & (F.col("cache_write_available") == F.col("requests")), ratio("cw_read", "cw_write")).alias("cache_reuse_efficiency"),
        ratio("output_tokens", "processed_input_tokens").alias("output_input_ratio"),
        ratio("costed_tokens", "processed_tokens").alias("cost_coverage"),
        ratio(F.col("processed_input_tokens") + F.col("output_tokens"), "processed_tokens").alias("classification_coverage"),
    )


def provider() -> Column:
    return canonical.merged_provider("canonical_provider_id").alias("provider")


def model() -> Column:
    return canonical.merged_model(F.coalesce("canonical_model_id", "raw_model_id")).alias("model")


def stored(by: str) -> Column:
    """What an event has of a dimension, as it was written. Queries group by it first: ids are made canonical once per group."""
    return {"provider": F.col("canonical_provider_id"), "model": F.coalesce("canonical_model_id", "raw_model_id"), "harness": F.col("harness")}[by].alias("stored")


def canonical_of(by: str) -> Column:
    """The value of a dimension at read time, of a column stored."""
    return {"provider": canonical.merged_provider, "model": canonical.merged_model, "harness": F.col}[by]("stored")


def local_day(zone: str, at: str = "occurred_at") -> Column:
    """The calendar day of an instant (UTC) in a zone."""
    return F.to_date(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone))


def day_start(day: Column, zone: str) -> Column:
    """The first instant (UTC) of a local day; skipped and repeated midnights included."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone).cast("timestamp_ntz")


def series_points(events: DataFrame, name: str, by: str = "provider", f: Filters = NONE, zone: str = "Europe/Berlin") -> DataFrame:
    """date, series, value, input_tokens of the days that have any; a rate keeps true zeros and drops days without input."""
    rows = apply(events, f).select(local_day(zone).alias("day"), stored(by), metric(name, requests(events)).alias("v"), F.col("processed_input_tokens").alias("i"))
    sums = rows.groupBy("day", "stored").agg(F.sum("v").alias("v"), F.sum("i").alias("i"))
    sums = sums.groupBy("day", canonical_of(by).alias("series")).agg(total("v").alias("v"), total("i").alias("input_tokens"))
    if name == "cacheHitRate":
        sums = sums.where("input_tokens > 0").withColumn("value", ratio("v", "input_tokens"))
    else:
        sums = sums.where("v > 0").withColumn("value", F.col("v").cast("double"))
    usd = to_usd("v") if name == "costUsd" else F.lit(None).cast("double")
    return sums.select(F.col("day").cast("string").alias("date"), "series", "value", "input_tokens", usd.alias("value_usd"))


#: Days that a spine holds at most: a limit of the accounting itself, as readers see it.
MOST_DAYS = 1000


def day_spine(events: DataFrame, f: Filters = NONE, zone: str = "Europe/Berlin", most_days: int = MOST_DAYS) -> DataFrame:
    """Every day of the period, of longer ones the first most_days; open ends are those of the data."""
    seen = apply(events, f).agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    lo = moment(f.since) if f.since else F.col("lo")
    hi = moment(f.until) - F.expr("INTERVAL 1 MILLISECOND") if f.until else F.col("hi")
    bounds = seen.select(lo.alias("lo"), hi.alias("hi")).select(F.coalesce("lo", "hi").alias("lo"), F.coalesce("hi", "lo").alias("hi")).where("lo is not null")
    bounds = bounds.select(local_day(zone, "lo").alias("a"), local_day(zone, "hi").alias("b")).select("a", F.greatest("a", F.least("b", F.date_add("a", most_days - 1))).alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b")).alias("day")).select(F.col("day").cast("string").alias("date"))


def timeseries(events: DataFrame, name: str, by: str = "provider", f: Filters = NONE, zone: str = "Europe/Berlin") -> DataFrame:
    """The spine (of at most MOST_DAYS days) with the points of each day; a day without any has one row without a series."""
    return day_spine(events, f, zone).join(series_points(events, name, by, f, zone), "date", "left")


def models(events: DataFrame, f: Filters = NONE, config: Config = Config()) -> DataFrame:
    """One row per model at read time with positive volume: tokens, sessions, hit rate, cost where any is known."""
    sums = ("processed_tokens", "processed_input_tokens", "fresh_input_tokens", "cache_read_input_tokens", "output_tokens")
    per = apply(events, f).groupBy(stored("model"), "session_id").agg(
        *(F.sum(c).alias(c) for c in sums),
        F.sum(costed()).alias("cost_nano"),
        F.sum(F.when(F.col("cost_available"), F.col("processed_tokens"))).alias("costed"),
        F.max("raw_model_id").alias("raw_model_id"),
    )
    # A session counts once for a model, whatever spellings it has.
    per = per.groupBy(canonical_of("model").alias("model"), "session_id").agg(*(F.sum(c).alias(c) for c in (*sums, "cost_nano", "costed")), F.max("raw_model_id").alias("raw_model_id"))
    agg = per.groupBy("model").agg(
        *(total(c).alias(c) for c in (*sums, "cost_nano", "costed")),
        F.count("session_id").alias("sessions"),
        F.max("raw_model_id").alias("raw_model_id"),
    )
    coverage = ratio("costed", "processed_tokens")
    return agg.where("processed_tokens > 0").select(
        "model",
        "raw_model_id",
        canonical.pretty_model(F.col("model"), F.col("model")).alias("display"),
        canonical.model_owner("model").alias("owner"),
        "processed_tokens",
        "processed_input_tokens",
        "fresh_input_tokens",
        "cache_read_input_tokens",
        "output_tokens",
        F.when(coverage > 0, to_usd("cost_nano")).alias("cost_usd"),
        coverage.alias("cost_coverage"),
        canonical.billing_mode(canonical.owner_segment("model"), config).alias("billing_mode"),
        "sessions",
        ratio("cache_read_input_tokens", "processed_input_tokens").alias("cache_hit_rate"),
    )


MIN_INPUT, MIN_SHARE, MAX_RATIO = 1_000_000, 0.05, 20


def attribution_cells(events: DataFrame, f: Filters = NONE, min_input: int = MIN_INPUT, min_share: float = MIN_SHARE, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Per harness and provider: the observed hit rate, and that of comparable other harnesses on the same provider.

    The provider filter takes effect on canonical ids after grouping. Cells are as few as there are harnesses and
    providers, so the join of a provider's cells is small whatever the number of events.
    """
    cells = apply(events, f.but(provider=())).groupBy("harness", stored("provider")).agg(F.sum("processed_input_tokens").alias("i"), F.sum("cache_read_input_tokens").alias("r"))
    cells = cells.groupBy("harness", canonical_of("provider").alias("provider")).agg(F.sum("i").alias("input"), F.sum("r").alias("read")).where("input > 0")
    if f.provider:
        cells = cells.where(F.array_contains(F.array(*(F.coalesce(canonical.canonical_provider(F.lit(p)), F.lit(p)) for p in f.provider)), F.col("provider")))
    mine, peer = cells.alias("a"), cells.alias("b")
    balanced = F.greatest("a.input", "b.input") <= F.least("a.input", "b.input") * max_ratio
    fits = (F.col("a.provider") == F.col("b.provider")) & (F.col("a.harness") != F.col("b.harness")) & (F.col("a.provider") != canonical.UNKNOWN)
    fits = fits & (F.col("a.input") >= min_input) & (F.col("b.input") >= min_input) & balanced
    met = mine.join(peer, fits, "left").groupBy("a.harness", "a.provider", "a.input", "a.read")
    met = met.agg(total("b.input").alias("comparator_input_tokens"), total("b.read").alias("comparator_read"), F.count("b.harness").alias("peers"))
    share = ratio("input", F.sum("input").over(Window.partitionBy("harness")))
    # The notes, the first that applies.
    note = (
        F.when(F.col("provider") == canonical.UNKNOWN, "provider is unknown")
        .when(share.isNull() | (share < min_share), "below 5% of harness input")
        .when(F.col("input") < min_input, "less than 1M input tokens")
        .when(F.col("peers") == 0, "no peer with at least 1M input and a 20×-balanced sample")
    )
    out = met.select("harness", "provider", "input", "read", "comparator_input_tokens", "comparator_read", share.alias("input_share"), note.alias("comparison_note"))
    other = F.when(F.col("comparison_note").isNull(), ratio("comparator_read", "comparator_input_tokens"))
    out = out.withColumns({"observed_rate": ratio("read", "input"), "other_harness_rate": other})
    return out.select(
        "harness",
        "provider",
        F.col("input").alias("processed_input_tokens"),
        F.col("read").alias("cache_read_input_tokens"),
        "observed_rate",
        "input_share",
        "other_harness_rate",
        "comparator_input_tokens",
        "comparison_note",
        (F.col("observed_rate") - F.col("other_harness_rate")).alias("lift"),
    )


def attribution(cells: DataFrame) -> DataFrame:
    """Per harness: what its hit rate is over comparable cells, and what peers' rates would make it."""
    both = F.col("other_harness_rate").isNotNull()
    agg = cells.groupBy("harness").agg(
        F.sum("processed_input_tokens").alias("processed_input_tokens"),
        F.sum("cache_read_input_tokens").alias("cache_read_input_tokens"),
        total(F.when(both, F.col("processed_input_tokens"))).alias("comparable"),
        total(F.when(both, F.col("cache_read_input_tokens"))).alias("comparable_read"),
        F.sum(F.when(both, F.col("processed_input_tokens") * F.col("other_harness_rate"))).alias("expected"),
    )
    out = agg.select(
        "harness",
        "processed_input_tokens",
        "cache_read_input_tokens",
        ratio("cache_read_input_tokens", "processed_input_tokens").alias("observed_rate"),
        ratio("comparable_read", "comparable").alias("comparable_observed_rate"),
        ratio("expected", "comparable").alias("provider_expected_rate"),
        ratio("comparable", "processed_input_tokens").alias("comparison_coverage"),
    )
    return out.withColumn("adjusted_lift", F.col("comparable_observed_rate") - F.col("provider_expected_rate"))


def provider_dimension(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Providers with their number of events and a display name from the aliases."""
    per = events.where("canonical_provider_id is not null").groupBy(stored("provider"), "raw_provider_id").agg(F.sum(requests(events)).alias("count"))
    per = per.groupBy(canonical_of("provider").alias("provider"), "raw_provider_id").agg(F.sum("count").alias("count"))
    label = canonical.choose(F.lower("raw_provider_id"), {r.lower(): d for r, d in config.provider_aliases}, F.lit(None).cast("string"))
    exact = F.lower("raw_provider_id") == F.col("provider")
    # An alias of the canonical spelling itself wins; otherwise the alias of the first spelling that has one.
    order = F.struct(F.coalesce(~exact, F.lit(True)), F.col("raw_provider_id"))
    out = per.groupBy("provider").agg(
        F.sum("count").alias("event_count"),
        F.min_by(label, F.when(label.isNotNull(), order)).alias("alias"),
        F.max_by("raw_provider_id", F.struct(F.coalesce(exact, F.lit(False)), F.col("raw_provider_id"))).alias("raw_provider_id"),
    )
    own = canonical.choose(F.col("provider"), {r.lower(): d for r, d in config.provider_aliases}, F.col("provider"))
    return out.select("provider", "raw_provider_id", F.when(F.col("provider") == canonical.UNKNOWN, "Unknown provider").otherwise(F.coalesce("alias", own)).alias("display"), "event_count")


def model_dimension(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Models, those without events included, with their events and tokens. known: column model_id of stored ids."""
    stored = events.where("canonical_model_id is not null").groupBy("canonical_model_id").agg(F.sum(requests(events)).alias("n"), F.sum("processed_tokens").alias("t"))
    if known is not None:
        stored = known.select(F.col("model_id").alias("canonical_model_id")).distinct().join(stored, "canonical_model_id", "left")
    merged = stored.groupBy(canonical.merged_model("canonical_model_id").alias("model")).agg(total("n").alias("event_count"), total("t").alias("total_tokens"))
    return merged.select("model", canonical.pretty_model(F.col("model"), F.col("model")).alias("display"), canonical.model_owner("model").alias("owner"), "event_count", "total_tokens")


def project_dimension(events: DataFrame, projects: DataFrame) -> DataFrame:
    """All projects and their number of events; events are counted before the join."""
    counts = events.groupBy("project_id").agg(F.count("*").alias("event_count"))
    return projects.join(counts, "project_id", "left").select("project_id", F.col("display_path").alias("path"), F.coalesce("event_count", F.lit(0)).alias("event_count"))


def harness_dimension(events: DataFrame) -> DataFrame:
    return events.select("harness").distinct()
