"""Near-duplicate vectors by inverted lists with product-quantised residuals and exact rerank.

Equal vectors are one class. Coarse centroids and residual codebooks are fitted on at most SAMPLE_VECTORS classes; every
class is then indexed: its list, its code and the exact length of its quantisation error. A query probes each list in
which a vector within the radius can lie: the whole radius must reach the half-space of that list's centroid, and the
ball that holds the list's members. In a list, one product with the decoded codes gives the distance from each query to each
code; by the triangle inequality a true neighbour is no further than the radius plus the code's error. Neither filter loses any.
What passes is compared by exact cosine. Of the lists within reach a query probes its own and later ones only: a pair
is found once, from its earlier list, and counts at both ends.

Neighbouring lists are dealt together as groups of some BLOCK members, and a query goes once to each group in which it
probes a list. Large lists and groups with many queries are dealt further, in blocks of bounded size; a pair of blocks
returns one count per vector and the edges of a spanning forest, never its pairs.

Edge cases: null or zero vectors, and those with null or non-finite components, link with nothing; vectors of
different lengths never link; equal vectors link with one another; rows that share a vec_id, or have none, are vectors of
their own with counts and components of their own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import ids, short_batches, table, with_nulls
from meterlake.llm.components import components, forest
from meterlake.session import written

THRESHOLD = 0.95
SAMPLE_VECTORS, MOST_LISTS, LIST_SIZE = 20_000, 4096, 200
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Members, and queries, of a pair of blocks.
BLOCK = 8192
SLACK = 1e-6


class Quantiser(NamedTuple):
    centroids: np.ndarray  # lists x d
    books: list[np.ndarray]  # for each subspace codes x width
    cuts: np.ndarray  # where subspaces begin and end

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each row, and squared distances to all centroids."""
        d = squared(x, self.centroids)
        return d.argmin(1), d

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they miss."""
        codes, missed = np.empty((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for j, book in enumerate(self.books):
            part = residual[:, self.cuts[j] : self.cuts[j + 1]]
            codes[:, j] = squared(part, book).argmin(1)
            missed += ((part - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centroids[lists] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, radius: float, extent: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each query, and the lists from it on that a vector within the radius can be in; extent: how far members lie from each centroid."""
        own, d = self.nearest(x)
        apart = np.sqrt(squared(self.centroids, self.centroids))[own]
        reach = (d - d[np.arange(len(x)), own][:, None]) <= 2 * apart * (radius + SLACK) + SLACK
        reach &= np.sqrt(d) <= extent + radius + SLACK
        reach &= np.arange(len(self.centroids)) > own[:, None]
        reach[np.arange(len(x)), own] = True
        return own, [np.flatnonzero(r) for r in reach]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = squared(x, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def fit(x: np.ndarray, lists: int, seed: int = 3) -> Quantiser:
    rng = np.random.default_rng(seed)
    centroids = k_means(x, lists, rng)
    residual = x - centroids[squared(x, centroids).argmin(1)]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    return Quantiser(centroids, [k_means(residual[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(ids("vec_id"), e.alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))


def classes(vectors: DataFrame) -> DataFrame:
    """The distinct vectors: embedding, the smallest vec_id, how many have it, and rep, a number of their own once written."""
    # Vectors are met by all their components; copies fold before the shuffle.
    distinct = vectors.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return distinct.withColumn("rep", F.monotonically_increasing_id())


LINKS = "a long, b long, n long"


def _index(batches: Iterator[pd.DataFrame], q: Quantiser) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            x = units(batch["embedding"])
            own, d = q.nearest(x)
            codes, missed = q.encode(x - q.centroids[own])
            yield pd.DataFrame({"list": own, "rep": batch["rep"], "n": batch["n"], "vector": [v.tobytes() for v in x], "code": [c.tobytes() for c in codes], "missed": missed, "away": np.sqrt(d[np.arange(len(x)), own])})


def list_groups(q: Quantiser, sizes: dict[int, int]) -> np.ndarray:
    """The group of each list: lists that follow each other on the centroids' main axis, up to BLOCK members together."""
    centred = q.centroids - q.centroids.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    group, held, out = 0, 0, np.zeros(len(q.centroids), np.int64)
    for i in np.argsort(centred @ axis, kind="stable").tolist():
        if held and held + sizes.get(i, 0) > BLOCK:
            group, held = group + 1, 0
        out[i] = group
        held += sizes.get(i, 0)
    return out


def _probe(batches: Iterator[pd.DataFrame], q: Quantiser, radius: float, extent: np.ndarray, group_of: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        if len(batch):
            x = np.frombuffer(b"".join(batch["vector"]), np.float64).reshape(len(batch), -1)
            for rep, n, vector, own, lists in zip(batch["rep"].tolist(), batch["n"].tolist(), batch["vector"], *q.probes(x, radius, extent), strict=True):
                groups = group_of[lists]
                rows += [(g, rep, n, own, vector, lists[groups == g]) for g in np.unique(groups).tolist()]
        yield pd.DataFrame(rows, columns=["group", "rep", "n", "own", "vector", "lists"])


def _compare(queries: pd.DataFrame, members: pd.DataFrame, q: Quantiser, threshold: float) -> pd.DataFrame:
    """Counts per vector and forest edges of one block of queries and one of a group's members."""
    empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    if not len(queries) or not len(members):
        return empty
    members = members.sort_values("list", kind="stable")
    x, y = (np.frombuffer(b"".join(f["vector"]), np.float64).reshape(len(f), -1) for f in (queries, members))
    codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(y), -1)
    bound = (np.sqrt(2 - 2 * threshold) + members["missed"].to_numpy() + SLACK) ** 2
    who, rep, home = queries["rep"].to_numpy(), members["rep"].to_numpy(), queries["own"].to_numpy()
    n_asking, n = queries["n"].to_numpy(), members["n"].to_numpy()
    n_probes = [len(v) for v in queries["lists"]]
    probed, asking = np.concatenate(queries["lists"].tolist()), np.repeat(np.arange(len(x)), n_probes)
    by_list = np.argsort(probed, kind="stable")
    probed, asking = probed[by_list], asking[by_list]
    edges, counts, back = (who[:0], who[:0]), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    lists = members["list"].to_numpy()
    decoded = q.decode(lists, codes)
    # Half of the squared distance to a code is within half of its bound where the product is at least this; queries are of length 1.
    least = ((decoded * decoded).sum(1) + 1 - bound) / 2
    for name in np.unique(lists).tolist():
        a, b = np.searchsorted(lists, [name, name + 1])
        who_asks = asking[slice(*np.searchsorted(probed, [name, name + 1]))]
        step = max(1, (1 << 19) // (b - a))
        for at in range(0, len(who_asks), step):
            own = who_asks[at : at + step]
            i, k = np.nonzero(x[own] @ decoded[a:b].T >= least[a:b])
            i, k = own[i], k + a
            # Within a list both ends ask: the smaller id stands for both.
            once = (who[i] != rep[k]) & ((home[i] < name) | (who[i] < rep[k]))
            i, k = i[once], k[once]
            near = np.einsum("ij,ij->i", x[i], y[k]) >= threshold
            i, k = i[near], k[near]
            np.add.at(counts, i, n[k])
            np.add.at(back, k, n_asking[i])
            # No step's pairs outlive it: what is held is a forest over the rows of the two blocks.
            if len(i):
                edges = forest(np.concatenate([edges[0], who[i]]), np.concatenate([edges[1], rep[k]]))
    a, b = edges
    if not len(a):
        return empty
    ends = [pd.DataFrame({"a": ids_[m > 0], "b": -1, "n": m[m > 0]}) for ids_, m in ((who, counts), (rep, back))]
    return pd.concat([pd.DataFrame({"a": a, "b": b, "n": 0}), *ends])


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Between distinct vectors of one length (embedding, rep, n): counts of linked rows (b = -1) and forest edges."""
    spark = distinct.sparkSession
    total = distinct.count()
    if total < 2:
        return spark.createDataFrame([], LINKS)
    # Nine tenths of the bound on average, so that hardly any row of the sample is cut off.
    step = max(1, -(-total * 10 // (SAMPLE_VECTORS * 9)))
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).orderBy("rep").limit(SAMPLE_VECTORS).select("embedding").toPandas()
    sample = sample if len(sample) else distinct.orderBy("rep").limit(SAMPLE_VECTORS).select("embedding").toPandas()
    fitted = fit(units(sample["embedding"]), min(MOST_LISTS, max(1, total // LIST_SIZE), len(sample)))
    held = spark.sparkContext.broadcast(fitted)
    radius = float(np.sqrt(2 - 2 * threshold))
    members = written(distinct.mapInPandas(lambda it: _index(it, held.value), "list int, rep long, n long, vector binary, code binary, missed double, away double"), "lists")
    # Two numbers for each of at most MOST_LISTS lists.
    held_lists = members.groupBy("list").agg(F.count("*").alias("size"), F.max("away").alias("away")).collect()
    group_of = list_groups(fitted, {r["list"]: r["size"] for r in held_lists})
    extent = np.full(len(fitted.centroids), -np.inf)
    for r in held_lists:
        extent[r["list"]] = r["away"]
    place = F.element_at(F.lit(group_of.tolist()), F.col("list") + 1).cast("long")
    members = members.drop("away").withColumn("group", place)
    asked = members.select("rep", "n", "vector").mapInPandas(lambda it: _probe(it, held.value, radius, extent, group_of), "group long, rep long, n long, own int, vector binary, lists array<int>")
    asked = written(asked, "probes")
    blocks = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    width = F.broadcast(blocks(members, "ms").join(blocks(asked, "qs"), "group"))
    own = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), "rep"), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    members = members.join(width, "group").withColumn("m", own(1, "ms")).withColumn("q", every("qs")).drop("ms", "qs")
    asked = asked.join(width, "group").withColumn("q", own(2, "qs")).withColumn("m", every("ms")).drop("ms", "qs")
    keys = ["group", "m", "q"]
    return asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(lambda a, b: _compare(a, b, held.value, threshold), LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: how many others it links with, and its component."""
    spark = vectors.sparkSession
    good = usable(short_batches(vectors))
    distinct = written(classes(good), "classes")
    # One number for each length of vector that occurs, nearly always one.
    lengths = [r[0] for r in distinct.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = spark.createDataFrame([], LINKS)
    for d in lengths:
        found = found.union(links(distinct.where(F.size("embedding") == d), threshold))
    found = written(found, "links")
    counts = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b <> -1").select("a", "b"))
    joined = written(distinct.select("rep", "least").join(parts.withColumnRenamed("id", "rep"), "rep"), "joined")
    # A component is called by the smallest vec_id of all its vectors.
    names = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component_id")
    # Every class has its place; vectors find theirs by the embedding itself.
    named = distinct.join(counts, "rep", "left").join(names, "rep", "left")
    named = named.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    single = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    bad = e.isNull() | ~F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) | ~F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    alone = single.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = with_nulls(linked, "vec_id", "component_id").union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""
