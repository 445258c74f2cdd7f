"""Near-duplicate texts against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from meterlake.llm import near_dedup, shingles
from meterlake.llm.components import components, forest


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    text = {r[0]: r[1] for r in rows}
    sets = {i: shingle_set(text[i], k) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def rows(words, edge_rows):
    r = random.Random(3)
    out = list(edge_rows)
    at = 1000
    for g in range(25):
        base = words(r.randint(20, 120), g).split()
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 9)):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            out.append((at, " ".join(w).replace(" ", r.choice([" ", "\t", " \n"]))))
            at += r.randint(1, 9)
    # A chain: every text is near the one before it, the last far from the first.
    chain = words(100, 77).split()
    for k in range(30):
        chain[3 * k] = f"c{k}"
        out.append((5000 - k, " ".join(chain)))
    out += [(6000 + k, "UPPER lower Case") for k in range(40)]
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components(documents, rows, k):
    got = near_dedup.near_duplicates(documents(rows, clash=True), words=k).collect()
    assert len(got) == len(rows)
    want = brute(rows, k)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_large_buckets_go_block_by_block(documents, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(8)
    base = words(60, 9).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([3, 7])):
            w[r.randrange(60)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(documents(rows), words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_keep_one(documents, edge_rows):
    df = documents(edge_rows, clash=True)
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == sorted((r[0] or 0) for r in edge_rows if r[0] != 5)


def test_sketches_fill_every_bin_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    table = shingles.sketches([np.unique(a), np.unique(b), a[:1], a[:0]])
    assert (table[:3] != shingles.EMPTY).all() and (table[3] == shingles.EMPTY).all()
    assert abs((table[0] == table[1]).mean() - 400 / 600) < 0.15


def test_components_of_a_graph(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 510), (510, 505), (700, 700)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 505: 500, 510: 500}
    a, b = forest(np.array([1, 2, 5, 1]), np.array([2, 3, 6, 3]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 2), (1, 3), (5, 6)]


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    assert near_dedup.keep_one(documents([(1, None), (2, "")])).count() == 2


def test_one_id_with_different_texts(documents):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " z"), (8, b + " z"), (9, "alone in this table of texts")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents(rows)).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(documents(rows)).collect()) == [5, 5, 9]
