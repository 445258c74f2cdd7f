"""The token and cost algebra: integers until the last projection, ratios of sums, null for a denominator of 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANO = 1_000_000_000

#: What a time series can show; rates need the input of their bucket as well.
METRICS = ("processedTokens", "processedInputTokens", "outputTokens", "freshInputTokens", "cacheReadInputTokens", "cacheHitRate", "costUsd", "requests")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(above: Column | str, below: Column | str) -> Column:
    above, below = c(above), c(below)
    return F.when(below > 0, above.cast("double") / below.cast("double"))


def to_nano(usd: Column | str) -> Column:
    return F.floor(c(usd) * NANO + 0.5).cast("long")


def to_usd(nano: Column | str) -> Column:
    return c(nano).cast("double") / NANO


def processed_input() -> Column:
    return F.col("fresh_input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_write_input_tokens")


def processed_of_parts() -> Column:
    """Processed tokens from their parts, as sessions and activity count them."""
    return F.col("processed_input_tokens") + F.col("output_tokens") + F.col("unattributed_tokens")


def costed() -> Column:
    """The cost where it is available; null is not zero."""
    return F.when(F.col("cost_available"), F.col("cost_nano_usd"))


def total(x: Column | str) -> Column:
    """A sum that is 0 for no rows."""
    return F.coalesce(F.sum(c(x)), F.lit(0)).cast("long")


def requests(rows: DataFrame) -> Column:
    """How many events a row stands for: those of a rollup say it, an event is one."""
    return F.col("requests") if "requests" in rows.columns else F.lit(1).cast("long")


def metric(name: str, weight: Column) -> Column:
    """What one row adds to a metric; for a rate, its numerator. weight: requests() of the rows."""
    columns = {
        "processedTokens": F.col("processed_tokens"),
        "processedInputTokens": F.col("processed_input_tokens"),
        "outputTokens": F.col("output_tokens"),
        "freshInputTokens": F.col("fresh_input_tokens"),
        "cacheReadInputTokens": F.col("cache_read_input_tokens"),
        "cacheHitRate": F.col("cache_read_input_tokens"),
        "costUsd": F.coalesce(costed(), F.lit(0)),
        "requests": weight,
    }
    return columns[name].cast("long")
