"""Removal of repeated strings against a dictionary of all strings; suffix order against sorting."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import repeats
from meterlake.llm.suffix_sort import V, sorted_buckets


def brute(rows, length):
    first, out = {}, {}
    texts = sorted({(i, (t or "").encode()) for i, t, *_ in rows if i is not None})
    for i, raw in texts:
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], (i, s))
    for i, raw in texts:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] != (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 60))
def test_suffix_order(data, bucket):
    depth = 40
    text = np.frombuffer(data + bytes(3 * depth + 4 * V), np.uint8)
    got = [x for part in sorted_buckets(text, len(data), np.arange(len(data)), depth, bucket) for x in part.tolist()]
    cut = lambda i: bytes(text[i : i + depth])
    assert sorted(got) == list(range(len(data)))
    assert all(cut(a) <= cut(b) for a, b in zip(got, got[1:], strict=False))


@pytest.fixture(scope="module")
def rows(words, edge_rows):
    r = random.Random(4)
    passages = [words(25, 100 + k) for k in range(4)] + ["ab" * 120, "z" * 230]
    out = [x if x[0] != 6 else (6, x[1][:20_000]) for x in edge_rows]
    for i in range(120):
        parts = [words(r.randint(3, 20), 1000 + i)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages)[: r.choice([90, 130, 400])], words(r.randint(0, 6), 3000 + i)]
        out.append((100 + i, " ".join(parts)))
    out += [(300 + k, out[20][1]) for k in range(10)]
    return out


def check(got, rows, length):
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("clash", [False, True])
def test_brute_force(documents, rows, clash):
    check(repeats.remove(documents(rows, clash)).collect(), rows, 100)


def test_hot_anchors_and_other_lengths(documents, rows):
    check(repeats.remove(documents(rows), length=60, gram=30, hot=3).collect(), rows, 60)


def test_groups_follow_all_hot_strings(spark, documents, words, monkeypatch):
    """Passages in 30 documents each, all with other surroundings: groups stay as small with 12 passages as with 2."""
    monkeypatch.setattr(repeats, "GROUP", 40)

    def largest(n):
        rows = [(100 * k + i, f"{words(6, 10_000 + 100 * k + i)} {words(9, 500 + k)} {words(6, 20_000 + 100 * k + i)}") for k in range(n) for i in range(30)]
        docs = documents(rows).selectExpr("doc_id", "cast(text AS binary) AS data")
        cut = repeats.dealt(docs, repeats.shared_contexts(docs, 60, 30), 60, hot=10)
        groups = cut.where("bucket < 0").groupBy("bucket").count().collect()
        check(repeats.remove(documents(rows), 60, 30, hot=10).collect(), rows, 60)
        return len(groups), max(r["count"] for r in groups)

    (few, _), (many, most) = largest(2), largest(12)
    assert many >= 3 * few and most <= 3 * 8 * 40


def test_equal_hot_strings_of_a_task_fold():
    raw, fold = bytes(range(65, 126)), repeats.Fold(60)
    for doc_id in (7, 5, 5, 9):
        fold.add_hot(3, doc_id, 0, raw)
    got = fold.rows()
    held = got[got["data"].notna()]
    assert {(x, np.frombuffer(d, np.int64)[0], np.frombuffer(s, np.int64)[0]) for x, d, s in zip(held["data"], held["docs"], held["los"], strict=True)} == {(raw[:60], 5, 0), (raw[1:], 5, 1)}
    done = got[got["data"].isna()]
    numbers = lambda column: np.frombuffer(b"".join(column), np.int64)
    spans = {(d, *x) for d, x in zip(numbers(done["docs"]).tolist(), numbers(done["los"]).reshape(-1, 2).tolist(), strict=True)}
    assert spans == {(7, 0, 61), (9, 0, 61)}


def test_sorted_bucket_issues_the_spans_of_copies():
    """A copy keeps its place until its bucket is sorted; equal bytes are sent and sorted once."""
    raw, fold = bytes(range(65, 165)), repeats.Fold(60)
    for place in ((4, 10), (2, 30), (2, 30), (3, 5)):
        fold.add(0, *place, raw)
    fold.add(0, 1, 7, raw[20:])
    got = fold.rows()
    assert len(got) == 2
    assert {tuple(x) for x in repeats._sort_group(got, 60).to_numpy().tolist()} == {(4, 10, 110), (3, 5, 105), (2, 50, 130)}


def test_all_spans_come_from_runs_of_the_sort(monkeypatch):
    """Where the order of the suffixes is kept back, neither a bucket nor a hot anchor issues a span."""
    raw = bytes(range(65, 165))

    def issued():
        fold = repeats.Fold(60)
        for doc_id in range(4):
            fold.add(0, doc_id, 5, raw)
            fold.add_hot(2, doc_id, 500, raw[:70])
        fold.add(0, 9, 0, raw[10:90])
        rows = fold.rows()
        return {tuple(x) for _, g in rows.groupby("bucket") for x in repeats._sort_group(g, 60).to_numpy().tolist()}

    assert issued() == {(k, 5, 105) for k in (1, 2, 3)} | {(9, 0, 80)} | {(k, 500, 570) for k in (1, 2, 3)}
    monkeypatch.setattr(repeats, "sorted_buckets", lambda *a: iter(()))
    assert issued() == set()


@pytest.mark.parametrize("held", [1, 400, 1 << 19])
def test_hot_contexts_sort_in_parts_alike(words, monkeypatch, held):
    """However much a task sorts at a time, the groups tell the same bytes of hot strings that start earlier."""
    import pandas as pd

    monkeypatch.setattr(repeats, "HELD_HOT", held)
    passage = words(20, 5).encode()[:90]
    texts = [words(2 + k % 3, 50 + k % 7).encode() + passage + b"%d" % (k % 4) for k in range(40)]
    batch = pd.DataFrame({"doc_id": range(40), "data": texts, "places": [[{"lo": 0, "size": len(x), "bucket": -3}] for x in texts]})
    sent = list(repeats._cut(iter([batch]), 60))
    assert (len(sent) > 1) == (held < 1 << 19)
    gone = [bytearray(len(x)) for x in texts]
    for _, group in pd.concat(sent).groupby("bucket"):
        for doc_id, start, stop in repeats._sort_group(group, 60).itertuples(index=False):
            gone[doc_id][start:stop] = b"\1" * (stop - start)
    want = brute([(k, x.decode()) for k, x in enumerate(texts)], 60)
    assert [sum(x) for x in gone] == [want[k][1] for k in range(40)]


def test_buckets_do_not_depend_on_hashes_being_equal():
    """Different contexts of one bucket are told apart by their bytes, whatever their anchors say."""
    fold = repeats.Fold(60)
    texts = [bytes([65 + k] * 70) for k in range(3)] + [bytes([65] * 60)]
    for k, x in enumerate(texts):
        fold.add(0, k, 0, x)
    assert {tuple(x) for x in repeats._sort_group(fold.rows(), 60).to_numpy().tolist()} == {(0, 1, 70), (1, 1, 70), (2, 1, 70), (3, 0, 60)}


def test_long_texts_are_read_in_pieces(monkeypatch, words):
    """Each string has the same anchor whatever the pieces are."""
    import pandas as pd

    raw = words(900, 3).encode()

    def anchors(piece):
        monkeypatch.setattr(repeats, "PIECE", piece)
        found = pd.concat(repeats._contexts(iter([pd.DataFrame({"doc_id": [1], "data": [raw]})]), 60, 30))
        return {s: r.anchor for r in found.itertuples() for s in range(r.lo, r.lo + r.size - 59)}

    assert anchors(101) == anchors(1 << 20)
    assert len(anchors(101)) == len(raw) - 59


def test_batches_fold_alike(documents, rows, monkeypatch):
    from meterlake.llm import common

    monkeypatch.setattr(common, "BATCH_ROWS", "7")
    check(repeats.remove(documents(rows)).collect(), rows, 100)


def test_kept_bytes(documents):
    text = "0123456789" * 12
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove(documents([(1, "head " + text), (2, text + " tail")])).collect()}
    want = brute([(1, "head " + text), (2, text + " tail")], 100)
    assert {i: hashlib.sha256(x).hexdigest() for i, x in got.items()} == {i: x[3] for i, x in want.items()}


def test_empty_table(documents):
    assert repeats.remove(documents([])).count() == 0
