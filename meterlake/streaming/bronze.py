"""Micro-batches of records into bronze: each batch is a folder of its own, so a replay writes the same again.

A batch is parted by a hash of the session, and looks for records that bronze has already in the parts that it touches:
the cost of a batch follows what those parts hold, not the whole history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from meterlake.operators import store

#: Parts of bronze by session.
PARTS = 64


def part() -> Column:
    return F.pmod(F.xxhash64("logical_session_id"), F.lit(PARTS)).cast("int")


def earlier(batch: DataFrame, bronze: str, batch_id: int, parts: list[int] | None = None) -> DataFrame | None:
    """What bronze holds apart from this batch, in these parts; None before the first."""
    try:
        held = batch.sparkSession.read.option("basePath", bronze).parquet(f"{bronze}/batch=*")
    except AnalysisException:
        return None
    held = held.where(F.col("batch") != batch_id)
    return held if parts is None else held.where(F.col("part").isin(*parts))


def append(incoming: DataFrame, bronze: str, batch_id: int) -> None:
    """The records that bronze has not, as the folder of this batch."""
    incoming = incoming.withColumn("part", part())
    # At most PARTS numbers.
    touched = [r["part"] for r in incoming.select("part").distinct().collect()]
    store.new_records(incoming, earlier(incoming, bronze, batch_id, touched)).write.partitionBy("part").mode("overwrite").parquet(f"{bronze}/batch={batch_id}")


def follow(records: DataFrame, bronze: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None) -> StreamingQuery:
    """Takes what has arrived since the checkpoint and ends, or looks again after each interval; a failed batch is taken again
    as a whole. A follower that still runs into the same bronze is returned instead of a second one."""
    spark, name = records.sparkSession, f"bronze {bronze}"
    for q in spark.streams.active:
        if q.name == name:
            return q
    out = records.writeStream.queryName(name).foreachBatch(lambda df, i: append(parse(df), bronze, i)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
