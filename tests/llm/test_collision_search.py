"""Nearest vectors against brute force."""

import numpy as np
import pytest

from meterlake.llm import collision_search as C
from meterlake.llm.common import NO_ID

SCHEMA = "vec_id long, embedding array<float>, label int"


def found(df, k=C.NEAREST, every=50):
    rows = C.usable(df)
    out = {}
    queries = rows.where((rows["vec_id"] != NO_ID) & (rows["vec_id"] % every == 0))
    for r in C.search(C.build_index(rows, k), queries, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute(vectors, k=C.NEAREST, every=50):
    ids = np.array(sorted(vectors))
    x = C.unit(np.array([vectors[i] for i in ids.tolist()], np.float64))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(n + 1, int(ids[j]), s[j]) for n, j in enumerate(order)]
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all([r for r, _, _ in got[q]] == list(range(1, len(want[q]) + 1)) for q in want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize(("d", "spread", "shard"), [(8, 0.3, 300), (64, 0.3, 500), (64, 9.0, 32_768), (200, 0.5, 700)])
def test_recall_on_clusters_and_noise(spark, monkeypatch, d, spread, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "ASKED", 16)
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(400, d))
    vectors = {i: (centres[rng.integers(400)] + spread * rng.normal(size=d)).astype(np.float32) for i in range(3000)}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA).repartition(4)
    got, want = found(df), brute(vectors)
    assert recall(got, want) >= 0.95
    truth = {q: {v: s for _, v, s in w} for q, w in want.items()}
    assert all(abs(s - truth[q][v]) < 1e-12 for q, g in got.items() for _, v, s in g if v in truth[q])


def test_windows_stay_narrow_where_neighbours_are_near(monkeypatch):
    rng = np.random.default_rng(3)
    x = C.unit(np.concatenate([rng.normal(size=(5000, 64)), rng.normal(size=64) + 0.01 * rng.normal(size=(50, 64))]))
    counted = []
    monkeypatch.setattr(np, "bincount", lambda a, minlength, real=np.bincount: counted.append(len(a)) or real(a, minlength=minlength))
    shard = C.Shard.of(x, np.argsort(C.directions(64) @ x.T, axis=1))
    places, _ = shard.nearest(x[5010], 6)
    near = sum(counted)
    counted.clear()
    shard.nearest(x[10], 6)
    assert set(places.tolist()) <= set(range(5000, 5050)) and near * 4 < sum(counted)


def test_copies_ties_and_hot_vectors(spark, monkeypatch):
    """Of many equal vectors the smallest ids answer, and no query answers itself."""
    monkeypatch.setattr(C, "SHARD", 100)
    rng = np.random.default_rng(1)
    same = rng.normal(size=16).astype(np.float32)
    vectors = {i: same if i % 3 == 0 else rng.normal(size=16).astype(np.float32) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA).repartition(3)
    got = found(df)
    for q, answers in got.items():
        if q % 3 == 0:
            assert [v for _, v, _ in answers] == [i for i in range(0, 30, 3) if i != q][:5]
    assert recall(got, brute(vectors)) >= 0.95
    assert C.entries(C.usable(df), 5).selectExpr("max(size(holders))").first()[0] == 6


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (350, [1.0, 0.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (400, [0.0, 1.0, 0.0]), (500, [5.0]), (None, [1.0, 0.0]), (450, [-1.0, 0.0]), (450, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA + ", shard string, row string")
    got = found(df)
    one, minus = pytest.approx(1.0), pytest.approx(-1.0)
    assert got[0] == [(1, 1, one), (2, None, one), (3, 2, 0.0), (4, 450, minus), (5, 450, minus)]
    assert got[350] == [(1, 400, 0.0)] and got[400] == [(1, 350, 0.0)]
    assert sorted(got) == [0, 350, 400, 450]
    assert sorted(got[450]) == sorted([(1, 450, one), (2, 2, 0.0), (3, 0, minus), (4, 1, minus), (5, None, minus)] * 2)


def test_whole_table_and_empty_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect() if r["embedding"]}
    got = {}
    for r in C.op13_nearest(spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert recall({q: sorted(v) for q, v in got.items()}, brute(vectors)) >= 0.9
    empty = C.usable(df.limit(0))
    assert C.search(C.build_index(empty), empty).count() == 0
