"""Single events: the projection that readers see, and pages of them in a total order."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import canonical
from meterlake.functions.metrics import costed, processed_of_parts
from meterlake.operators.filters import Filters, apply

PAGE, MOST = 100, 250
SORTS = ("oldest", "recent", "largest", "model", "fresh", "cache", "output", "cost")


def read(events: DataFrame) -> DataFrame:
    """Events as they are shown: canonical ids of today, whatever was stored."""
    return events.withColumns(
        {
            "canonical_provider_id": F.coalesce(canonical.canonical_provider("canonical_provider_id"), "canonical_provider_id"),
            "canonical_model_id": F.coalesce(canonical.canonical_model("canonical_model_id"), "canonical_model_id"),
        }
    )


def sort_key(sort: str) -> Column:
    id_ = F.coalesce("canonical_model_id", "raw_model_id", F.lit("Unknown"))
    keys = {
        "oldest": F.col("occurred_at"),
        "recent": F.col("occurred_at"),
        "largest": processed_of_parts(),
        "model": F.lower(F.substring(id_, F.instr(id_, "/") + 1, F.length(id_))),
        "fresh": F.col("fresh_input_tokens"),
        "cache": F.col("cache_read_input_tokens"),
        "output": F.col("output_tokens"),
        "cost": costed(),
    }
    return keys[sort]


def encode_cursor(value: object, id_: str) -> str:
    return base64.urlsafe_b64encode(f"{'null' if value is None else value}|{id_}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str, sort: str) -> tuple[str, str]:
    """The value and id of a cursor; ValueError for what no page has given out."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,1024}", cursor):
        raise ValueError("malformed cursor")
    try:
        value, bar, id_ = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().rpartition("|")
    except ValueError:
        raise ValueError("malformed cursor") from None
    numeric = sort in ("largest", "fresh", "cache", "output", "cost")
    if not bar or not id_ or (numeric and not re.fullmatch(r"-?\d+|null" if sort == "cost" else r"-?\d+", value)):
        raise ValueError("malformed cursor")
    return value, id_


def ascending(sort: str, order: str | None) -> bool:
    return (order or ("asc" if sort in ("oldest", "model") else "desc")) == "asc"


def page(events: DataFrame, f: Filters = Filters(), cursor: str | None = None, size: int = PAGE, sort: str = "oldest", order: str | None = None) -> DataFrame:
    """The events after a cursor, one more than the page holds so that a next page shows; sort_value is their key."""
    up = ascending(sort, order)
    rows = apply(events, f).withColumn("sort_value", sort_key(sort))
    key = F.col("sort_value")
    if cursor:
        value, id_ = decode_cursor(cursor, sort)
        beyond = F.col("id") > id_ if up else F.col("id") < id_
        if value == "null" and sort == "cost":
            rows = rows.where(key.isNull() & beyond)
        else:
            at = F.lit(value).cast(rows.schema["sort_value"].dataType)
            later = (key > at if up else key < at) | ((key == at) & beyond)
            rows = rows.where(later | key.isNull() if sort == "cost" else later)
    ways = [key.asc_nulls_last(), F.col("id").asc()] if up else [key.desc_nulls_last(), F.col("id").desc()]
    return read(rows.orderBy(*ways).limit(min(max(1, size or PAGE), MOST) + 1))


def next_cursor(rows: list, size: int) -> str | None:
    """The cursor of the page after these rows of page(); None on the last one."""
    size = min(max(1, size or PAGE), MOST)
    return encode_cursor(rows[size - 1]["sort_value"], rows[size - 1]["id"]) if len(rows) > size else None


def count(events: DataFrame, f: Filters = Filters()) -> DataFrame:
    return apply(events, f).agg(F.count("*").alias("total"))
