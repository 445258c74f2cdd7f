"""Exact duplicates against grouping in plain Python, and the perfect hash on its own."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import exact_dedup as E


def digest(text):
    return hashlib.sha256(re.sub("[ \t-\r]+", " ", text or "").encode()).hexdigest()


def groups(rows):
    by = defaultdict(list)
    for i, text, *_ in rows:
        by[digest(text)].append(i)
    return by


@settings(max_examples=30, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300), st.sets(st.binary(min_size=32, max_size=32), max_size=50))
def test_minimal_and_perfect(members, others):
    keys = np.frombuffer(b"".join(sorted(members)), np.uint8).reshape(-1, 32)
    levels, slots = E.build_levels(keys)
    assert sorted(slots.tolist()) == list(range(len(members)))
    assert (E.find_slots(levels, keys) == slots).all()
    strangers = sorted(others - members)
    found = E.find_slots(levels, np.frombuffer(b"".join(strangers), np.uint8).reshape(-1, 32))
    held = keys[np.argsort(slots)]
    assert all(s < 0 or held[s].tobytes() != x for s, x in zip(found, strangers, strict=True))


@pytest.mark.parametrize("clash", [False, True])
def test_decisions(documents, edge_rows, clash):
    rows = [*edge_rows, *((100 + i, f"copy\t\t of {i % 7}") for i in range(200)), *((400 + i, f"copy of {i % 5}") for i in range(50))]
    by = groups(rows)
    got = E.decide(documents(rows, clash)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = by[r["text_sha256"]]
        ids = [i for i in own if i is not None]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == (min(ids) if ids else None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len(by)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_keep_first(documents, edge_rows):
    df = documents(edge_rows, clash=True)
    out = E.keep_first(df)
    assert out.columns == df.columns
    assert sorted(digest(r["text"]) for r in out.collect()) == sorted(groups(edge_rows))


def test_history_decides(spark, documents):
    keyed = E.keyed_documents(documents([(10, "a"), (11, "b"), (1, "a"), (2, "c"), (3, "c")]))
    from pyspark.sql import functions as F

    got = {r["keep_id"]: (r["historical"], r["group_size"]) for r in E.groups(keyed, F.col("doc_id") >= 10).collect()}
    assert got == {10: (True, 2), 11: (True, 1), 2: (False, 2)}


def test_empty_table(documents):
    assert E.decide(documents([])).count() == 0
    assert E.keep_first(documents([])).count() == 0
