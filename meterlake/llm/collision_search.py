"""Nearest vectors by collision counting on single projections.

Every vector is indexed in a shard of bounded size, dealt by hash. A shard holds one sorted array for each of PROJECTIONS
orthonormal directions: the order of its vectors along it. A query opens a window around its own place in every array and
widens all of them together, as if buckets of one width were merged to buckets of the next (virtual rehashing): a step
reads only what the windows have gained. A vector that lies in at least `needed` of the windows is verified by its exact
cosine. For the radius of a step the windows are so wide that a vector at that distance misses the threshold with a
probability of about one in ten, nearer ones less; the search in a shard ends when its k-th best verified vector is no
further than the radius. Queries go to each shard in blocks, and the best k of the shards' answers are theirs.

Equal vectors are one entry of the index, with the k + 1 smallest ids: others could be in no answer, since ties go to the
smaller id and a query leaves out no more than itself. Cosines are those of unit vectors in double precision; distance and
cosine order unit vectors alike.

What it costs: each query meets each shard. Where vectors have near neighbours the windows stay narrow; where they have
none, as random ones in many dimensions, windows take in about half of a shard, so the work is queries times vectors.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
answers; vectors of another length are no candidates; a query with fewer than k candidates gets all; rows without
vec_id are candidates that come last among ties, and no queries; rows that repeat a vec_id are candidates and queries of
their own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meterlake.llm.common import NO_ID, ids, short_batches, table, with_nulls
from meterlake.session import written

NEAREST = 5
PROJECTIONS = 64
#: Vectors of a shard; queries that meet a shard in one task.
SHARD, ASKED = 32_768, 512
#: Radii of the steps: the first, and the factor from one to the next.
FIRST_RADIUS, WIDER = 0.1, math.sqrt(2)
#: Half a window in standard deviations of a projected difference at the radius, the chance to lie in it, and how many standard deviations below its mean the count of collisions may be.
REACH, CHANCE, BELOW = 0.95, math.erf(0.95 / math.sqrt(2)), 1.28

INDEX = "width int, shard int, holders array<array<struct<vec_id:long,row:long>>>, vectors binary, orders binary"
FOUND = "row long, query_id long, vec_id long, other long, score double"


def directions(width: int, seed: int = 13) -> np.ndarray:
    """Orthonormal directions, PROJECTIONS or, in fewer dimensions, several bases one after the other."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    while sum(map(len, out)) < PROJECTIONS:
        out.append(np.linalg.qr(rng.normal(size=(width, width)))[0].T)
    return np.concatenate(out)[:PROJECTIONS]


def needed() -> int:
    """Collisions from which on a vector is verified."""
    return max(1, math.floor(PROJECTIONS * CHANCE - BELOW * math.sqrt(PROJECTIONS * CHANCE * (1 - CHANCE))))


class Shard(NamedTuple):
    vectors: np.ndarray  # n x width, unit length
    order: np.ndarray  # PROJECTIONS x n, one after the other: vectors along each direction
    places: np.ndarray  # their projections; direction j has 4 j added, so that all are one sorted array

    @staticmethod
    def of(vectors: np.ndarray, order: np.ndarray) -> Shard:
        along = directions(vectors.shape[1]) @ vectors.T
        places = np.take_along_axis(along, order, 1) + 4.0 * np.arange(PROJECTIONS)[:, None]
        return Shard(vectors, order.ravel().astype(np.intp), places.ravel())

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the best k vectors found, best first, and all that tie with the last of them."""
        n, width = self.vectors.shape
        centre = directions_of(width) @ query + 4.0 * np.arange(PROJECTIONS)
        lows = highs = np.searchsorted(self.places, centre)
        floor, ceiling = np.arange(PROJECTIONS) * n, (np.arange(PROJECTIONS) + 1) * n
        counts, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        found, scores, radius, enough = np.empty(0, np.intp), np.empty(0), FIRST_RADIUS, needed()
        while True:
            half = REACH * radius / math.sqrt(width)
            low = np.maximum(np.searchsorted(self.places, centre - half), floor)
            high = np.minimum(np.searchsorted(self.places, centre + half, "right"), ceiling)
            low, high = np.minimum(low, lows), np.maximum(high, highs)
            gained = [self.order[a:b] for a, b in zip(low.tolist(), lows.tolist(), strict=True) if a < b] + [self.order[a:b] for a, b in zip(highs.tolist(), high.tolist(), strict=True) if a < b]
            lows, highs = low, high
            if gained:
                counts += np.bincount(np.concatenate(gained), minlength=n)
                new = np.flatnonzero((counts >= enough) & ~verified)
                verified[new] = True
                cosines = np.einsum("ij,j->i", self.vectors[new], query)
                found, scores = np.concatenate([found, new]), np.concatenate([scores, cosines])
                if len(found) > k:
                    kept = scores >= np.partition(scores, -k)[-k]
                    found, scores = found[kept], scores[kept]
            whole = bool((low == floor).all() and (high == ceiling).all())
            if len(found) >= k:
                last = math.sqrt(max(0.0, 2 - 2 * scores.min()))
                if last <= radius or whole:
                    break
                radius = min(radius * WIDER, max(last, radius))
            elif whole:
                break
            else:
                radius *= WIDER
        best = np.argsort(-scores, kind="stable")
        return found[best], scores[best]


_directions: dict[int, np.ndarray] = {}


def directions_of(width: int) -> np.ndarray:
    """directions(), made once by a worker for the last width."""
    if width not in _directions:
        _directions.clear()
        _directions[width] = directions(width)
    return _directions[width]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (NO_ID for none), row (a number of its own) and the components as doubles, of the vectors that take part; written."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(ids("vec_id"), e.alias("embedding")).where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest holders (vec_id, row): the rank is cut before the exchange and after it."""
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256)))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id", "row"))
    least = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    holders = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    return least.groupBy("digest").agg(F.first("embedding").alias("embedding"), holders.alias("holders"))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _shard(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """The sorted arrays of one shard."""
    rows = rows.sort_by("digest")
    vectors = unit(np.array(rows["embedding"].to_pylist(), np.float64))
    order = np.argsort(directions_of(vectors.shape[1]) @ vectors.T, axis=1, kind="stable").astype(np.uint32)
    held = {"width": rows["width"][0].as_py(), "shard": rows["shard"][0].as_py(), "holders": rows["holders"].to_pylist(), "vectors": vectors.tobytes(), "orders": order.tobytes()}
    return pa.Table.from_pylist([held], schema)


def build_index(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """One row for each shard of usable(): its vectors, who holds them, and their order along each direction; written."""
    distinct = entries(rows, k).withColumn("width", F.size("embedding"))
    distinct = written(distinct, "entries")
    # One number for each length of vector that occurs, nearly always one.
    many = F.broadcast(distinct.groupBy("width").agg(F.ceil(F.count("*") / F.lit(SHARD)).alias("shards")))
    dealt = distinct.join(many, "width").withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int")).drop("shards")
    schema = _arrow(INDEX)
    return written(dealt.groupBy("width", "shard").applyInArrow(lambda t: _shard(t, schema), INDEX), "index")


def _ask(queries: pa.Table, shards: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best of one shard for each of a block of queries."""
    out: dict[str, list] = {c: [] for c in schema.names}
    if len(queries) and len(shards):
        (held,) = shards.to_pylist()
        vectors = np.frombuffer(held["vectors"], np.float64).reshape(-1, held["width"])
        shard = Shard.of(vectors, np.frombuffer(held["orders"], np.uint32).reshape(PROJECTIONS, -1))
        asked = unit(np.array(queries["embedding"].to_pylist(), np.float64))
        for row, query_id, query in zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), asked, strict=True):
            # One more, as the query itself may be among them.
            places, scores = shard.nearest(query, k + 1)
            met = [(-s, h["vec_id"], h["row"]) for p, s in zip(places.tolist(), scores.tolist(), strict=True) for h in held["holders"][p] if h["row"] != row]
            for s, vec_id, other in sorted(met)[:k]:
                for c, v in zip(schema.names, (row, query_id, vec_id, other, -s), strict=True):
                    out[c].append(v)
    return pa.table(out, schema)


def search(index: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of an index that was built for this k, for each query.

    queries: vec_id, row and embedding as usable() gives them. Ties go to the smaller vec_id.
    """
    # A row for each of the shards of the query's width, and for each of the blocks of queries.
    asked = queries.select("row", "vec_id", "embedding", F.size("embedding").alias("width"))
    blocks = asked.groupBy("width").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("blocks"))
    shards = index.groupBy("width").agg(F.count("*").cast("int").alias("shards"))
    # One row for each length of vector.
    counts = F.broadcast(blocks.join(shards, "width"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(counts, "width").withColumns({"block": F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"), "shard": every("shards")}).drop("blocks", "shards")
    right = index.join(counts, "width").withColumn("block", every("blocks")).drop("blocks", "shards")
    keys, schema = ["width", "shard", "block"], _arrow(FOUND)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _ask(a, b, k, schema), FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return with_nulls(best.select("query_id", "rank", "vec_id", "score"), "vec_id")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(short_batches(table(spark, sf_dir, "embeddings")))
    return search(build_index(rows), rows.where((F.col("vec_id") != NO_ID) & (F.col("vec_id") % 50 == 0)))
