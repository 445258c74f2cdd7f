"""Derived measures of reports: change, composition, shares, comparison, intensity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.metrics import c, ratio, total
from meterlake.operators.filters import Filters, apply

ISO = "%Y-%m-%dT%H:%M:%S"
#: Days of the presets; all has no start.
PRESETS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365, "all": None}


def preset(name: str, now: datetime) -> Filters:
    n = PRESETS[name]
    return Filters(since=(now - timedelta(days=n)).strftime(ISO) if n else None, until=now.strftime(ISO))


def previous(f: Filters) -> Filters:
    """The window of the same length that ends where this one begins."""
    a, b = datetime.fromisoformat(f.since), datetime.fromisoformat(f.until)
    return f.but(since=(a - (b - a)).strftime(ISO), until=f.since)


def intersection(f: Filters, day_start: str, day_end: str) -> Filters:
    """A picked day within the period."""
    return f.but(since=max(filter(None, (f.since, day_start))), until=min(filter(None, (f.until, day_end))))


def change(events: DataFrame, f: Filters, measure: str = "processed_tokens") -> DataFrame:
    """This window, the one before and the relative change, in one pass over both."""
    from meterlake.operators.filters import moment

    both = apply(events, f.but(since=previous(f).since))
    now = F.col("occurred_at") >= moment(f.since)
    agg = both.agg(total(F.when(now, F.col(measure))).alias("current"), total(F.when(~now, F.col(measure))).alias("previous"))
    return agg.withColumn("change", ratio("current", "previous") - 1)


def composition(events: DataFrame, f: Filters = Filters()) -> DataFrame:
    """component, tokens: reasoning is part of the output and shown apart from what is visible."""
    agg = apply(events, f).agg(*(total(x).alias(x) for x in ("cache_read_input_tokens", "fresh_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "unattributed_tokens")))
    parts = agg.select(
        F.col("cache_read_input_tokens").alias("cached"),
        F.col("fresh_input_tokens").alias("fresh"),
        F.col("cache_write_input_tokens").alias("write"),
        F.greatest(F.lit(0), F.col("output_tokens") - F.col("reasoning_output_tokens")).alias("visible_output"),
        F.col("reasoning_output_tokens").alias("reasoning"),
        F.col("unattributed_tokens").alias("unattributed"),
    )
    return parts.unpivot([], parts.columns, "component", "tokens")


def cost_per_million(cost_usd: Column | str, tokens: Column | str) -> Column:
    return F.when(c(tokens) > 0, c(cost_usd) / (c(tokens).cast("double") / 1_000_000))


def uncached_cost(cost_usd: Column | str, hit_rate: Column | str) -> Column:
    """What the same tokens would cost without cache; never more than twenty times as much."""
    return c(cost_usd) / F.greatest(F.lit(0.05), 1 - c(hit_rate))


def savings(cost_usd: Column | str, hit_rate: Column | str) -> Column:
    return F.greatest(F.lit(0.0), uncached_cost(cost_usd, hit_rate) - c(cost_usd))


def top_series(points: DataFrame, n: int, rate: bool = False) -> DataFrame:
    """The series with the largest totals; rates are weighted by their input."""
    value = F.col("value") * F.col("input_tokens") if rate else F.col("value")
    agg = points.groupBy("series").agg(F.sum(value).alias("v"), F.sum("input_tokens").alias("i"))
    score = F.col("v") / F.col("i") if rate else F.col("v")
    return agg.select("series", score.alias("score")).orderBy(F.desc("score"), "series").limit(n)


def daily_total(points: DataFrame, rate: bool = False) -> DataFrame:
    """One value per day over all series; a rate is weighted by input."""
    if rate:
        return points.groupBy("date").agg((F.sum(F.col("value") * F.col("input_tokens")) / F.sum("input_tokens")).alias("value"))
    return points.groupBy("date").agg(F.sum("value").alias("value"))


def comparison(harnesses: DataFrame) -> DataFrame:
    """harness, metric, value, scored, best. harnesses: one row each with the columns below.

    Lift counts from a comparison coverage of 0.7, cost from a cost coverage of 0.5; a best needs two that count.
    """
    rows = harnesses.select(
        "harness",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), scored.alias("enough"), F.lit(low).alias("low"))
                    for name, scored, low in (
                        ("cache_hit_rate", F.lit(True), False),
                        ("adjusted_lift", F.coalesce(F.col("comparison_coverage") >= 0.7, F.lit(False)), False),
                        ("output_input_ratio", F.lit(True), False),
                        ("cost_per_million", F.coalesce(F.col("cost_coverage") >= 0.5, F.lit(False)), True),
                    )
                )
            )
        ),
    )
    rows = rows.withColumn("scored", F.col("enough") & F.col("value").isNotNull())
    own = F.when(F.col("scored"), F.when(F.col("low"), -F.col("value")).otherwise(F.col("value")))
    w = Window.partitionBy("metric")
    best = F.col("scored") & (F.count(own).over(w) > 1) & (own == F.max(own).over(w))
    return rows.select("harness", "metric", "value", "scored", best.alias("best"))


def shares(models: DataFrame) -> DataFrame:
    """Each model's share of all tokens, and whether its cost is partial."""
    everything = models.agg(F.sum("processed_tokens").alias("all"))
    partial = F.col("cost_usd").isNotNull() & (F.col("cost_coverage") < 0.99)
    return models.crossJoin(F.broadcast(everything)).select("model", "processed_tokens", ratio("processed_tokens", "all").alias("share"), F.coalesce(partial, F.lit(False)).alias("partial_cost"))


def intensity(days: DataFrame) -> DataFrame:
    """Level 0 to 4 of each day: how many of the quartile cuts of the active days it exceeds, and one for any use.

    Days are as many as a calendar has, so the sorted list is small.
    """
    active = days.where("processed_tokens > 0").agg(F.sort_array(F.collect_list("processed_tokens")).alias("s"))
    cut = lambda p: F.try_element_at("s", F.least(F.size("s"), F.floor(F.lit(p) * F.size("s")).cast("int") + 1))
    cuts = active.select(cut(0.25).alias("q1"), cut(0.5).alias("q2"), cut(0.75).alias("q3"))
    t = F.col("processed_tokens")
    level = F.when(t <= 0, 0).when(t > F.col("q3"), 4).when(t > F.col("q2"), 3).when(t > F.col("q1"), 2).otherwise(1)
    return days.join(F.broadcast(cuts)).select("date", "processed_tokens", level.cast("int").alias("level"))


def week_grid(days: DataFrame) -> DataFrame:
    """Column (week) and row (Monday first) of each day, from the first one on."""
    first = days.agg(F.min("date").alias("first"))
    offset = F.weekday(F.col("first").cast("date"))
    place = F.date_diff(F.col("date").cast("date"), F.col("first").cast("date")) + offset
    return days.join(F.broadcast(first)).select("date", F.floor(place / 7).cast("int").alias("week"), (place % 7).cast("int").alias("row"))


def model_shares(usage: DataFrame, sort: str = "tokens", order: str = "desc") -> DataFrame:
    """A session's models with their share of its tokens (null for none) and their place in a sort by model, tokens, share or cost.

    usage: session_id, model, provider, processed_tokens, cost_usd. What is not known comes last either way; ties by name and provider.
    """
    own = Window.partitionBy("session_id")
    all_tokens = F.sum("processed_tokens").over(own)
    key = {"model": F.col("model"), "cost": F.col("cost_usd")}.get(sort, F.col("processed_tokens"))
    way = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
    provider = F.col("provider").desc() if sort == "model" and order == "desc" else F.col("provider").asc()
    place = F.row_number().over(own.orderBy(way, F.col("model").asc(), provider))
    return usage.withColumns({"share": F.when(all_tokens > 0, F.col("processed_tokens").cast("double") / all_tokens), "place": place.cast("long")})


def span_text(first: Column | str, last: Column | str) -> Column:
    """The time between two instants as days and hours, hours and minutes, or minutes."""
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    minutes = F.floor(F.greatest(F.lit(0), micros(last) - micros(first)) / 60_000_000).cast("long")
    part = lambda n, unit: F.concat(F.floor(n).cast("long").cast("string"), F.lit(unit))
    hours, days = minutes / 60, minutes / 1440
    return (
        F.when(minutes < 1, "<1m")
        .when(minutes >= 1440, F.concat_ws(" ", part(days, "d"), part((minutes % 1440) / 60, "h")))
        .when(minutes >= 60, F.concat_ws(" ", part(hours, "h"), part(minutes % 60, "m")))
        .otherwise(part(minutes, "m"))
    )
