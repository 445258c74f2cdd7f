"""A rollup under the summaries: rows that stand for many events and have the columns of events.

cells hold sums by quarter of an hour (UTC) and stored dimensions, visits the distinct sessions and turns of the same grain.
Every function of usage and activity takes rows() in the place of events, and gives the same: requests says how many events
a row stands for, occurred_at is the start of its quarter. Offsets of time zones are whole quarters (since 1972), so a quarter
lies in one local day of any zone. Periods that cut a quarter take the events of that quarter alone from the facts. Ids stay
as they were stored, so routes that change later act on cells too.

cells and visits add up over any division of the events, so a store keeps them part by part: what a run touches is
computed again, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.metrics import costed
from meterlake.operators.filters import Filters, apply

QUARTER = timedelta(minutes=15)
DIMENSIONS = ("harness", "canonical_provider_id", "raw_provider_id", "canonical_model_id", "raw_model_id", "project_id")
#: What is known of a request; a cell holds requests of which the same is known, so that null stays apart from zero.
KNOWN = ("cache_write_available", "cost_available")
SUMS = (
    "processed_tokens", "processed_input_tokens", "fresh_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens",
    "unattributed_tokens", "cost_nano_usd"
)
WHO = ("session_id", "turn_id")
COLUMNS = ("occurred_at", *DIMENSIONS, *KNOWN, *SUMS, *WHO)


@dataclass(frozen=True)
class Rollup:
    cells: DataFrame
    visits: DataFrame
    events: DataFrame


def quarter(at: str = "occurred_at") -> Column:
    """The start of the quarter of an hour in which an instant lies."""
    return F.expr(f"{at} - make_dt_interval(0, 0, minute({at}) % 15, extract(SECOND FROM {at}))")


def cells(events: DataFrame, *more: str) -> DataFrame:
    """Sums of events; more: further columns to keep apart."""
    rows = events.withColumns({"occurred_at": quarter(), "reasoned": F.col("reasoning_output_tokens").isNotNull(), "cost_nano_usd": costed()})
    return rows.groupBy(*more, "occurred_at", *DIMENSIONS, *KNOWN, "reasoned").agg(*(F.sum(c).alias(c) for c in SUMS), F.count("*").alias("requests")).drop("reasoned")


def visits(events: DataFrame, *more: str) -> DataFrame:
    """Who was there: each session and turn once for a quarter and its dimensions."""
    return events.withColumn("occurred_at", quarter()).select(*more, "occurred_at", *DIMENSIONS, *WHO).distinct()


def rolled(events: DataFrame, keep) -> Rollup:
    """The rollup of a table of events; keep writes a table under a name and gives it back."""
    return Rollup(keep(cells(events), "cells"), keep(visits(events), "visits"), events)


def _instant(text: str) -> datetime:
    """The bound as filters.moment() reads it."""
    at = datetime.fromisoformat(text)
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def _bound(at: datetime) -> Column:
    return F.lit(at.isoformat(" ")).cast("timestamp_ntz")


def _floor(at: datetime) -> datetime:
    return at - (at - datetime.min) % QUARTER


def whole(f: Filters) -> tuple[datetime | None, datetime | None, list[tuple[datetime, datetime]]]:
    """The quarters that lie in the period as a whole, from one instant up to another, and the spans beside them: two at most."""
    since, until = (_instant(x) if x else None for x in (f.since, f.until))
    first = None if since is None else _floor(since + QUARTER - timedelta(microseconds=1))
    last = None if until is None else _floor(until)
    if first is not None and last is not None and first >= last:
        # Less than a quarter is whole: all of it comes from events.
        return first, first, [(since, until)] if since < until else []
    spans = [(since, first)] if since != first else []
    return first, last, spans + ([(last, until)] if until != last else [])


def rows(r: Rollup, f: Filters = Filters(), who: bool = True) -> DataFrame:
    """What stands for the events of a period; other filters are left to the query, which takes the same f.

    who: whether sessions and turns are counted; without, visits are not read. One session has few events: it is read from them.
    """
    if f.session is not None:
        return apply(r.events, f)
    first, last, spans = whole(f)
    at = F.col("occurred_at")
    inside = F.lit(True)
    inside = inside if first is None else inside & (at >= _bound(first))
    inside = inside if last is None else inside & (at < _bound(last))
    out = r.cells.where(inside).select(*(c for c in COLUMNS if c not in WHO), *(F.lit(None).cast("string").alias(c) for c in WHO), "requests")
    if who:
        out = out.unionByName(r.visits.where(inside), allowMissingColumns=True)
    for a, b in spans:
        beside = r.events.where((at >= _bound(a)) & (at < _bound(b)))
        out = out.unionByName(beside.select(*COLUMNS, F.lit(1).cast("long").alias("requests")))
    return out
