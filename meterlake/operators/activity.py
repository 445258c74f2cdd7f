"""Activity by local day, clipped to a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import processed_of_parts, requests, total
from meterlake.operators.filters import Filters, apply, moment
from meterlake.operators.usage import day_start, local_day


def period(events: DataFrame, f: Filters, zone: str, now: str) -> DataFrame:
    """One row: the first and last local day. Without since, the day of the first event; never beyond today."""
    first = apply(events, f.but(since=None)).agg(F.min("occurred_at").alias("first"))
    lo = moment(f.since) if f.since else F.coalesce("first", moment(now))
    hi = F.least(moment(f.until) - F.expr("INTERVAL 1 MILLISECOND"), moment(now)) if f.until else moment(now)
    return first.select(lo.alias("lo"), hi.alias("hi")).select(local_day(zone, "lo").alias("a"), local_day(zone, "hi").alias("b"))


def days(events: DataFrame, f: Filters, zone: str, now: str) -> DataFrame:
    """Every day of the period with its window (start included, stop not), in UTC and clipped to the period."""
    spine = period(events, f, zone, now).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("day"))
    start, stop = day_start(F.col("day"), zone), day_start(F.date_add("day", 1), zone)
    start = F.greatest(start, moment(f.since)) if f.since else start
    stop = F.least(stop, moment(f.until)) if f.until else stop
    return spine.select("day", start.alias("day_start"), stop.alias("day_end"))


def by_harness(events: DataFrame, f: Filters, zone: str, now: str) -> DataFrame:
    """date, harness and their sessions, tokens and requests. Events are counted by local day before they meet the spine."""
    rows = apply(events, f).select(local_day(zone).alias("day"), "harness", "session_id", processed_of_parts().alias("t"), requests(events).alias("n"))
    counts = rows.groupBy("day", "harness").agg(F.countDistinct("session_id").alias("sessions"), F.sum("t").alias("processed_tokens"), F.sum("n").alias("requests"))
    spine = days(events, f, zone, now).select("day")
    return counts.join(F.broadcast(spine), "day", "left_semi").select(F.col("day").cast("string").alias("date"), "harness", "sessions", "processed_tokens", "requests")


def daily(events: DataFrame, f: Filters, zone: str, now: str) -> DataFrame:
    """Every day of the period. Session ids belong to one harness, so their counts add up."""
    per = by_harness(events, f, zone, now).groupBy("date").agg(*(F.sum(c).alias(c) for c in ("sessions", "processed_tokens", "requests")))
    spine = days(events, f, zone, now).select(F.col("day").cast("string").alias("date"))
    return spine.join(per, "date", "left").select("date", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "processed_tokens", "requests")))


def totals(events: DataFrame, f: Filters, zone: str, now: str) -> DataFrame:
    """Distinct sessions, tokens, requests and days with any, over the period."""
    spine = days(events, f, zone, now).select("day")
    rows = apply(events, f).withColumn("day", local_day(zone)).join(F.broadcast(spine), "day", "left_semi")
    grain = rows.groupBy("session_id", "day").agg(F.sum(processed_of_parts()).alias("t"), F.sum(requests(rows)).alias("n"))
    return grain.agg(F.countDistinct("session_id").alias("sessions"), total("t").alias("processed_tokens"), total("n").alias("requests"), F.countDistinct("day").alias("active_days"))
