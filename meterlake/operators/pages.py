"""Pages of events from a layout in ranges of their sort key: a page reads the few ranges that can hold it.

laid() writes the events by repartitionByRange, one folder for each range, and beside them a small table of counts: for each
range and stored dimensions, how many events there are, between which keys and which times. page() looks there up to which
range enough events surely pass the filters, and gives that to the scan as partition filters; within those ranges it is
events.page(), so rows and cursors are the same as without a layout. What counts cannot say (a period or a cursor that cuts a
range, one session) is not counted on, so more is read, never less.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators import events as single
from meterlake.operators.filters import Filters, moment, predicate
from meterlake.session import shared_folder

#: Events of one range.
RANGE_ROWS = 1_000_000
DIMENSIONS = ("harness", "canonical_provider_id", "canonical_model_id", "project_id")


@dataclass(frozen=True)
class Layout:
    """rows: events with sort_value, blank (it is null) and range; counts: as described above."""

    sort: str
    rows: DataFrame
    counts: DataFrame


def laid(events: DataFrame, sort: str, range_rows: int = RANGE_ROWS) -> Layout:
    """Writes events in the order of sort to the shared folder. Events without a key, of which only costs have any, come last."""
    spark, path, counted = events.sparkSession, shared_folder(events.sparkSession, "pages"), shared_folder(events.sparkSession, "counts")
    rows = events.withColumn("sort_value", single.sort_key(sort)).withColumn("blank", F.col("sort_value").isNull())
    ranges = max(1, -(-events.count() // range_rows))
    rows = rows.repartitionByRange(ranges, "blank", "sort_value", "id").withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", "blank", "sort_value", "id")
    rows.write.partitionBy("range").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    ends = {f"{end}_{name}": f(c) for name, c in (("key", "sort_value"), ("at", "occurred_at")) for end, f in (("low", F.min), ("high", F.max))}
    counts = rows.groupBy("range", "blank", *DIMENSIONS).agg(F.count("*").alias("n"), F.count("occurred_at").alias("timed"), *(c.alias(n) for n, c in ends.items()))
    counts.write.parquet(counted)
    return Layout(sort, rows, spark.read.schema(counts.schema).parquet(counted))


def _bounds(layout: Layout, f: Filters, cursor: str | None, up: bool) -> tuple[Column, Column]:
    """Whether events of a line of counts can be on the page or later, and whether all of them are."""
    maybe, surely = predicate(f.but(since=None, until=None, session=None)), F.lit(f.session is None)
    if f.since:
        maybe, surely = maybe & (F.col("high_at") >= moment(f.since)), surely & (F.col("low_at") >= moment(f.since))
    if f.until:
        maybe, surely = maybe & (F.col("low_at") < moment(f.until)), surely & (F.col("high_at") < moment(f.until))
    if f.since or f.until:
        surely = surely & (F.col("timed") == F.col("n"))
    if cursor:
        value, _ = single.decode_cursor(cursor, layout.sort)
        if value == "null" and layout.sort == "cost":
            maybe, surely = maybe & F.col("blank"), F.lit(False)
        else:
            at = F.lit(value).cast(layout.rows.schema["sort_value"].dataType)
            near, far = (F.col("high_key") >= at, F.col("low_key") > at) if up else (F.col("low_key") <= at, F.col("high_key") < at)
            maybe, surely = maybe & (F.col("blank") | near), surely & (F.col("blank") | far)
    return maybe, F.coalesce(maybe & surely, F.lit(False))


def pruned(layout: Layout, f: Filters, cursor: str | None, size: int, up: bool) -> DataFrame:
    """The ranges of a layout that can hold size events after the cursor."""
    maybe, surely = _bounds(layout, f, cursor, up)
    step = lambda: F.struct("blank", (F.col("range") if up else -F.col("range")).alias("step"))
    near = layout.counts.where(maybe).select(step().alias("at"), F.when(surely, F.col("n")).otherwise(0).alias("n"))
    first = near.agg(F.min("at")).first()[0]
    if first is None:
        return layout.rows.where(F.lit(False))
    # Every such step holds an event of the page, so as many steps as it has events are enough.
    steps = near.groupBy("at").agg(F.sum("n").alias("n")).where("n > 0").orderBy("at").limit(size).collect()
    seen, last = 0, None
    for r in steps:
        seen, last = seen + r["n"], r["at"]
        if seen >= size:
            break
    blank, place = F.col("blank"), F.col("range") if up else -F.col("range")
    after = lambda at: place >= at["step"]
    rows = layout.rows.where(blank & after(first)) if first["blank"] else layout.rows.where(blank | after(first))
    if seen < size:
        return rows
    return rows.where(~blank | (place <= last["step"])) if last["blank"] else rows.where(~blank & (place <= last["step"]))


def page(layout: Layout, f: Filters = Filters(), cursor: str | None = None, size: int = single.PAGE, order: str | None = None) -> DataFrame:
    """events.page() over the ranges that it needs; next_cursor() goes on from it."""
    most = min(max(1, size or single.PAGE), single.MOST) + 1
    rows = pruned(layout, f, cursor, most, single.ascending(layout.sort, order))
    return single.page(rows, f, cursor, size, layout.sort, order).drop("blank", "range")
