"""Shared steps of ingestion: numbers, vectors against their predecessors, bursts, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest integer that a double holds exactly.
SAFE = (1 << 53) - 1
VECTOR = ("input", "cached", "write", "output", "reasoning", "total")
#: Gaps below this many milliseconds belong to the replay at the start of a forked session.
BURST_MS = 1000


def number(json: Column | str, *paths: str) -> Column:
    """The first of several JSON paths that is a number."""
    json = F.col(json) if isinstance(json, str) else json
    return F.coalesce(*(F.get_json_object(json, p).try_cast("double") for p in paths))


def text(json: Column | str, *paths: str) -> Column:
    """The first of several JSON paths that is not empty."""
    json = F.col(json) if isinstance(json, str) else json
    return F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths))


def safe(x: Column) -> Column:
    """The number as a long if it is a whole one from 0 to SAFE; otherwise null."""
    return F.when((x >= 0) & (x <= SAFE) & (F.floor(x) == x), x.cast("long"))


def clamped(x: Column) -> Column:
    """The number cut to a whole one, at least 0; null and non-numbers count as 0."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0), F.least(x, F.lit(float(SAFE)))).cast("long")).otherwise(F.lit(0).cast("long"))


def carried(c: Column | str, keys: list[str], order: str = "ordinal") -> Column:
    """The last value so far, in order."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def first_seen(c: Column | str, keys: list[str], order: str = "ordinal") -> Column:
    """The first value so far, in order."""
    return F.first(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def per_request(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Vectors of single requests: kind (usage, duplicate, quarantine) and reason, and their classes.

    rows: keys, order and the columns of VECTOR. A vector equal to the one before it is a duplicate.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    vector = F.struct(*VECTOR)
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in VECTOR}
    negative = F.array_min(F.array(*filled.values())) < 0
    reason = (
        F.when(negative, "negative-token-count")
        .when(filled["cached"] + filled["write"] > filled["input"] + 1, "impossible-cache-relationship")
        .when(filled["reasoning"] > filled["output"] + 1, "impossible-reasoning-relationship")
        .when(F.col("total").isNotNull() & (F.col("total") + 1 < filled["input"] + filled["output"]), "impossible-total-relationship")
    )
    rows = rows.withColumn("__same", F.lag(vector).over(w).eqNullSafe(vector)).withColumn("reason", reason)
    kind = F.when(F.col("__same"), "duplicate").when(F.col("reason").isNotNull(), "quarantine").otherwise("usage")
    rows = rows.withColumn("kind", kind).withColumn("reason", F.when(F.col("kind") == "quarantine", F.col("reason")))
    return rows.withColumns(
        {
            "fresh": F.greatest(F.lit(0), filled["input"] - filled["cached"] - filled["write"]),
            "unattributed": F.greatest(F.lit(0), filled["total"] - filled["input"] - filled["output"]),
        }
    ).drop("__same")


def cumulative(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Running totals as differences: kind (baseline, usage, duplicate, quarantine), reason, the differences and their classes.

    The predecessor is the row before, whatever became of it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = {c: F.lag(c).over(w) for c in VECTOR}
    optional = ("write", "reasoning")
    delta = {f"d_{c}": F.col(c) - before[c] if c in optional else F.coalesce(F.col(c), F.lit(0)) - F.coalesce(before[c], F.lit(0)) for c in VECTOR}
    both = {f"{c}_available": F.col(c).isNotNull() & before[c].isNotNull() for c in optional}
    same = F.lag(F.struct(*VECTOR)).over(w).eqNullSafe(F.struct(*VECTOR))
    rows = rows.withColumns({"__first": F.row_number().over(w) == 1, "__same": same, **delta, **both})
    # Parts that are not known on both sides count as no difference.
    d = {c: F.coalesce(F.col(f"d_{c}"), F.lit(0)) for c in VECTOR}
    reason = F.when(F.array_min(F.array(*d.values())) < 0, "non-monotonic-cumulative").when(d["cached"] + d["write"] > d["input"] + 1, "impossible-cache-relationship")
    kind = F.when(F.col("__first"), "baseline").when(F.col("__same"), "duplicate").when(reason.isNotNull(), "quarantine").otherwise("usage")
    rows = rows.withColumns({"kind": kind, "reason": F.when(kind == "quarantine", reason)})
    return rows.withColumns(
        {"fresh": F.greatest(F.lit(0), d["input"] - d["cached"] - d["write"]), "unattributed": F.greatest(F.lit(0), d["total"] - d["input"] - d["output"])}
    ).drop("__first", "__same")


def replayed(rows: DataFrame, keys: list[str], at: str = "occurred_at", forked: Column | None = None, order: str = "ordinal", anchor: Column | None = None, settled: Column | None = None) -> DataFrame:
    """Marks the leading events of forked sessions whose gaps stay below BURST_MS: a replay of what is known.

    The first gap is counted from the anchor, the time at which the fork was named; without one from the first event. The
    first gap that is longer, negative or unknown ends the replay for good. settled: what was decided already of rows that
    stand for more than themselves; null for the others.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.when(F.row_number().over(w) == 1, anchor if anchor is not None else F.col(at)).otherwise(F.lag(at).over(w))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000
    within = F.coalesce((gap >= 0) & (gap < BURST_MS), F.lit(False))
    rows = rows.withColumn("__within", within if settled is None else F.coalesce(settled, within))
    so_far = F.min("__within").over(w.rowsBetween(Window.unboundedPreceding, 0))
    test = so_far if forked is None else so_far & forked
    return rows.withColumn("suppressed", test).drop("__within")


def is_last(test: Column, keys: list[str], order: str = "ordinal") -> Column:
    """Whether a row is the last of its group for which the test holds."""
    return F.coalesce(F.max(F.when(test, F.col(order))).over(Window.partitionBy(*keys)) == F.col(order), F.lit(False))


def is_first(test: Column, keys: list[str], order: str = "ordinal") -> Column:
    """Whether a row is the first of its group for which the test holds."""
    return F.coalesce(F.min(F.when(test, F.col(order))).over(Window.partitionBy(*keys)) == F.col(order), F.lit(False))


def snapshots(rows: DataFrame, keys: list[str], vector: list[str], order: str = "ordinal") -> DataFrame:
    """Snapshots of one response: equal to the one before it, duplicate; the last of those that differ stands."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.struct(*vector)
    rows = rows.withColumn("duplicate", F.lag(v).over(w).eqNullSafe(v))
    last = F.max(F.when(~F.col("duplicate"), F.col(order))).over(Window.partitionBy(*keys))
    return rows.withColumn("current", ~F.col("duplicate") & (F.col(order) == last))
