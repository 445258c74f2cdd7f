"""Pages from a layout of many small ranges against pages over all events, walked from end to end."""

import pytest

from meterlake.operators import events as single
from meterlake.operators import pages
from meterlake.operators.filters import Filters
from meterlake.plans.facts import facts
from meterlake.session import written


@pytest.fixture(scope="module")
def rows(spark, data):
    return written(facts(spark, data), "facts")


FILTERS = (Filters(), Filters(since="2024-01-05", until="2024-01-20T12:00:00Z", harness=("view", "purchase")), Filters(provider=("zai",), session="view:3"))


@pytest.mark.parametrize("sort, order", [("oldest", None), ("largest", None), ("model", "desc"), ("cost", "asc"), ("cost", "desc")])
def test_pages_are_those_over_all_events(rows, sort, order):
    """From the start, from the middle, at the last key, from the events without a key, and beyond the end."""
    layout = pages.laid(rows, sort, 60)
    for f in FILTERS if sort in ("oldest", "cost") else FILTERS[:2]:
        ways = single.page(rows, f, None, 250, sort, order).collect()
        cursors = [None] + [single.encode_cursor(r["sort_value"], r["id"]) for r in (ways[0], ways[len(ways) // 2], ways[-1])]
        cursors += [single.encode_cursor(None, "5")] if sort == "cost" else []
        for cursor in cursors:
            want = [(r["id"], r["sort_value"]) for r in single.page(rows, f, cursor, 40, sort, order).collect()]
            assert [(r["id"], r["sort_value"]) for r in pages.page(layout, f, cursor, 40, order).collect()] == want, (f, cursor)


def test_a_page_reads_few_ranges(rows):
    layout = pages.laid(rows, "largest", 60)
    ranges = layout.rows.select("range").distinct().count()
    read = lambda *args: {r[0] for r in pages.pruned(layout, *args).select("range").distinct().collect()}
    assert ranges > 10 and layout.counts.agg({"n": "sum"}).first()[0] == rows.count()
    assert len(read(Filters(), None, 41, False)) <= 2
    middle = single.page(rows, size=250, sort="largest").collect()[200]
    assert len(read(Filters(), single.encode_cursor(middle["sort_value"], middle["id"]), 41, False)) <= 3
    assert len(read(Filters(harness=("nobody",)), None, 41, False)) == 0
    # The ranges reach the scan as a filter of partitions.
    plan = pages.page(layout, Filters(), None, 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan


def test_no_events(spark, rows):
    layout = pages.laid(rows.where("false"), "cost")
    assert pages.page(layout).isEmpty()
