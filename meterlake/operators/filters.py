"""The filters of every analytic query: a conjunction of predicates that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import canonical


@dataclass(frozen=True)
class Filters:
    """since is included, until is not; empty lists do not filter."""

    since: str | None = None
    until: str | None = None
    harness: tuple[str, ...] = ()
    provider: tuple[str, ...] = ()
    model: tuple[str, ...] = ()
    project: tuple[str, ...] = ()
    session: str | None = None

    def but(self, **changes) -> Filters:
        return replace(self, **changes)


def parsed(**raw: str | Sequence[str] | None) -> Filters:
    """Filters from request parameters: lists repeat or are joined by commas; blanks are dropped."""
    lists = {}
    for name in ("harness", "provider", "model", "project"):
        value = raw.get(name) or ()
        parts = [value] if isinstance(value, str) else list(value)
        lists[name] = tuple(x.strip() for part in parts for x in part.split(",") if x.strip())
    return Filters(raw.get("since") or None, raw.get("until") or None, session=raw.get("session") or None, **lists)


def moment(text: str) -> Column:
    """A bound as a timestamp: a day, a local date-time, or an instant with an offset, in UTC."""
    zoned = text.endswith("Z") or "+" in text[10:] or "-" in text[10:]
    return F.to_utc_timestamp(F.lit(text).cast("timestamp"), F.current_timezone()).cast("timestamp_ntz") if zoned else F.lit(text).cast("timestamp_ntz")


def provider_is(wanted: Sequence[str], stored: str = "canonical_provider_id") -> Column:
    """Every stored spelling that reads as one of the wanted providers."""
    keys = F.array(*(F.coalesce(canonical.canonical_provider(F.lit(w)), F.lit(w)) for w in wanted))
    own = F.coalesce(canonical.canonical_provider(stored), F.lit(canonical.UNKNOWN))
    return F.array_contains(keys, own) | F.coalesce(F.col(stored).isin(*wanted), F.lit(False))


def model_is(wanted: Sequence[str], stored: str = "canonical_model_id") -> Column:
    keys = F.array(*(F.coalesce(canonical.canonical_model(F.lit(w)), F.lit(w)) for w in wanted))
    return F.array_contains(keys, canonical.merged_model(stored)) | F.coalesce(F.col(stored).isin(*wanted), F.lit(False))


def predicate(f: Filters) -> Column:
    tests = [F.lit(True)]
    if f.session is not None:
        tests.append(F.col("session_id") == f.session)
    if f.since:
        tests.append(F.col("occurred_at") >= moment(f.since))
    if f.until:
        tests.append(F.col("occurred_at") < moment(f.until))
    if f.harness:
        tests.append(F.col("harness").isin(*f.harness))
    if f.provider:
        tests.append(provider_is(f.provider))
    if f.model:
        tests.append(model_is(f.model))
    if f.project:
        tests.append(F.col("project_id").isin(*f.project))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def apply(events: DataFrame, f: Filters) -> DataFrame:
    return events.where(predicate(f))


def like_text(column: Column, search: str) -> Column:
    """Contains, whatever the case; percent and underscore are themselves."""
    escaped = "".join("\\" + ch if ch in "\\%_" else ch for ch in search)
    return F.coalesce(F.ilike(column, F.lit(f"%{escaped}%"), F.lit("\\")), F.lit(False))
