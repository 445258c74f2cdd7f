"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from meterlake.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, threshold=0.95):
    """n_links and component of each usable vector."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= threshold
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {v: (int(near[k].sum()) - 1, ids[find(k)]) for k, v in enumerate(ids)}


def clusters(rng, n, d, spread):
    centres = rng.normal(size=(n // 4, d))
    return {i: (centres[rng.integers(len(centres))] + spread * rng.normal(size=d)).astype(np.float32) for i in range(n)}


@pytest.mark.parametrize(("d", "spread"), [(8, 0.15), (64, 0.15)])
def test_recall_and_precision(spark, monkeypatch, d, spread):
    monkeypatch.setattr(E, "LIST_SIZE", 20)
    vectors = clusters(np.random.default_rng(d), 1500, d, spread)
    vectors[3] = vectors[700]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in vectors.items()], SCHEMA).repartition(4)
    got = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    want = brute(vectors)
    # Probes reach the whole radius in any number of dimensions: recall is 1.
    assert sum(n for n, _ in want.values()) > 1000
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want


@pytest.mark.parametrize(("rank", "d"), [(4, 64), (8, 768)])
def test_low_rank_vectors_lose_no_link(spark, monkeypatch, rank, d):
    """Steps of vectors that fill few of their dimensions run along the differences of centroids."""
    monkeypatch.setattr(E, "LIST_SIZE", 20)
    rng = np.random.default_rng(rank)
    x = (clusters(rng, 1000, rank, 0.2), np.linalg.qr(rng.normal(size=(d, rank)))[0].T)
    vectors = {i: (v @ x[1]).astype(np.float32) for i, v in x[0].items()}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA).repartition(4)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()} == brute(vectors)


def test_blocks_of_large_lists(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    vectors = clusters(np.random.default_rng(5), 300, 6, 0.1)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()} == brute(vectors)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [-1.0, 0.0]), (12, [1.0, 0.0]), (12, [1.0, 0.0]), (13, [1e-30, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA + ", rep string, n string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11)]
    linked = [(1, 4, 1, True), (2, 4, 1, False), (12, 4, 1, False), (12, 4, 1, False), (13, 4, 1, False), (9, 1, 9, True), (10, 1, 9, False)]
    assert got == sorted(alone + linked)


def test_one_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, -1.0]), (None, [0.0, 1.0, 0.01])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(map(repr, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect())))
    # Both vectors of id 1 are linked, with different ones; of the rows without id one is, under the name of the other.
    assert got == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (None, 1, 1, True)]))


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("d", [5, 64])
def test_decoded_codes_are_as_far_as_their_parts_say(d):
    """The product with decoded codes passes and leaves what the sum over subspaces does."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(400, d))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q = E.fit(x, 6)
    lists, _ = q.nearest(x)
    codes, missed = q.encode(x - q.centroids[lists])
    decoded = q.decode(lists, codes)
    assert np.allclose(np.sqrt(((x - decoded) ** 2).sum(1)), missed)
    parts = np.zeros((len(x), len(x)))
    for name in range(6):
        own = np.flatnonzero(lists == name)
        for j, book in enumerate(q.books):
            parts[:, own] += E.squared((x - q.centroids[name])[:, q.cuts[j] : q.cuts[j + 1]], book)[:, codes[own, j]]
    assert np.allclose(E.squared(x, decoded), parts)
