"""Queries over a rollup against the same queries over its events."""

import random
from datetime import datetime, timedelta

import pytest

from meterlake.functions.config import Config
from meterlake.operators import activity, rollup, usage
from meterlake.operators.filters import Filters
from meterlake.plans.facts import FACT
from meterlake.session import written
from meterlake.streaming import sync as S
from meterlake.streaming.commits import Store

from test_sync import dump, usage as message


@pytest.fixture(scope="module")
def made(spark):
    """Events at and beside the ends of quarters, with nulls in every dimension and measure that may have them."""
    r, names = random.Random(11), [c.split()[0] for c in FACT.replace("\n", " ").split(", ")]
    rows = []
    for i in range(300):
        at = datetime(2024, 3, 30, 12) + r.randrange(300) * timedelta(minutes=15) + r.choice((timedelta(0), timedelta(microseconds=1), timedelta(minutes=7), timedelta(minutes=15) - timedelta(microseconds=1)))
        s, fresh, read, write, output = r.randrange(9), r.randrange(50), r.randrange(50), r.randrange(5), r.randrange(90)
        row = dict.fromkeys(names) | {
            "id": str(i), "harness": f"h{s % 3}", "occurred_at": at, "session_id": f"h{s % 3}:{s}", "logical_session_id": str(s), "turn_id": r.choice((None, "t1", f"t{s}")), "project_id": r.choice((None, "p")),
            "raw_provider_id": r.choice((None, "glm", "zai")), "canonical_provider_id": r.choice((None, "glm", "zai", "openai")), "raw_model_id": r.choice((None, "gpt-5")), "canonical_model_id": r.choice((None, "gpt-5", "openai/gpt-5", "x")),
            "fresh_input_tokens": fresh, "cache_read_input_tokens": read, "cache_write_input_tokens": write, "processed_input_tokens": fresh + read + write, "output_tokens": output, "unattributed_tokens": 0,
            "processed_tokens": fresh + read + write + output, "cache_write_available": r.random() < 0.7, "cost_available": r.random() < 0.5, "cost_nano_usd": r.choice((0, 10**9, 7)), "reasoning_output_tokens": r.choice((None, 0, 4)),
        }
        rows += [tuple((row | {"id": f"{i}{copy}"})[n] for n in names) for copy in "ab"[: 1 + i % 2]]
    events = written(spark.createDataFrame(rows, FACT), "events")
    return rollup.rolled(events, written)


PERIODS = {
    "all": Filters(),
    "whole quarters": Filters(since="2024-03-31", until="2024-04-02T10:15:00Z", provider=("zai",)),
    "cut": Filters(since="2024-03-30T20:07:00", until="2024-04-01T11:14:59.999999", model=("gpt-5",)),
    "offset": Filters(since="2024-03-31T02:00:00.000001+02:00"),
    "within one quarter": Filters(since="2024-03-31T10:00:00.000001", until="2024-03-31T10:10:00"),
    "over one border": Filters(since="2024-03-31T10:07:00", until="2024-03-31T10:20:00"),
    "empty": Filters(since="2025-01-01T00:01:00", until="2024-01-01T00:02:00"),
    "session": Filters(session="h1:4"),
}
NOW = "2024-04-03T00:00:00Z"


def plain(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", sorted(PERIODS))
def test_the_same_as_from_events(made, name):
    f = PERIODS[name]
    rows, sums = rollup.rows(made, f), rollup.rows(made, f, who=False)
    for by in (None, {"model": usage.model()}):
        assert plain(usage.summary(rows, f, by)) == plain(usage.summary(made.events, f, by))
    for metric in ("requests", "costUsd"):
        assert plain(usage.series_points(sums, metric, "model", f, "Asia/Kathmandu")) == plain(usage.series_points(made.events, metric, "model", f, "Asia/Kathmandu"))
    assert plain(activity.daily(rows, f, "Asia/Kathmandu", NOW)) == plain(activity.daily(made.events, f, "Asia/Kathmandu", NOW))
    assert plain(activity.totals(rows, f, "America/New_York", NOW)) == plain(activity.totals(made.events, f, "America/New_York", NOW))
    assert plain(usage.models(rows, f)) == plain(usage.models(made.events, f))
    assert plain(usage.attribution_cells(sums, f, 10, 0.01)) == plain(usage.attribution_cells(made.events, f, 10, 0.01))


def test_whole_quarters_read_no_event(made):
    read = lambda f, **more: set(rollup.rows(made, f, **more).inputFiles())
    cells, visits, events = (set(x.inputFiles()) for x in (made.cells, made.visits, made.events))
    assert read(PERIODS["whole quarters"]) == cells | visits
    assert read(PERIODS["all"], who=False) == cells
    assert read(PERIODS["cut"]) == cells | visits | events
    assert made.cells.count() < made.events.count()


def test_no_events(spark):
    r = rollup.rolled(spark.createDataFrame([], FACT), written)
    assert plain(usage.summary(rollup.rows(r))) == plain(usage.summary(r.events))
    assert rollup.rows(r).isEmpty()


def test_a_store_keeps_its_rollup_part_by_part(spark, tmp_path):
    """After each run, a renormalisation and without a source: the rollup of the facts as they are."""
    logs, st = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 4)
    logs.mkdir()
    source = S.Source("s", "pi", f"file://{logs}")
    assert S.rolled(st) is None

    def same():
        got, facts = S.rolled(st), st.read("facts")
        assert plain(usage.summary(rollup.rows(got), by={"harness": usage.model()})) == plain(usage.summary(facts, by={"harness": usage.model()}))
        assert plain(activity.by_harness(rollup.rows(got), Filters(), "UTC", NOW)) == plain(activity.by_harness(facts, Filters(), "UTC", NOW))

    for name in "ab":
        (logs / f"{name}.jsonl").write_bytes(dump([message(i, sessionId=f"{name}{i}") for i in range(5)] + [message(9, sessionId="shared", usage={"input": ord(name)})]))
        S.sync(st, [source])
        same()
    held = st.tables()["cells"].parts
    with (logs / "b.jsonl").open("ab") as f:
        f.write(dump([message(20, sessionId="b1")]))
    S.sync(st, [source])
    same()
    assert sum(st.tables()["cells"].parts.get(p) != found for p, found in held.items()) <= 1
    # A store of before the rollup gets all of it with its next change.
    change = st.begin()
    change.drop("cells"), change.drop("visits")
    change.commit()
    with (logs / "b.jsonl").open("ab") as f:
        f.write(dump([message(21, sessionId="b1")]))
    S.sync(st, [source])
    same()
    S.renormalise(st, Config(cutoff="2026-01-01T00:00:03"))
    same()
    S.forget(st, source, Config())
    same()
