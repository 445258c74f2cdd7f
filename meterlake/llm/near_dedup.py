"""Near-duplicate texts: fast similarity sketches, banding, and exact verification on full shingle sets.

Texts with equal sets are one class, which has a number of its own; its name is its smallest doc_id, and a component's name
the smallest of its classes. Classes that share a band are candidates, and every candidate pair between different components is verified on the full sets, unless it falls to a
bound that a linked pair keeps to (sizes; one bit of each bin at six standard deviations).

No group's pairs are listed. First, every class of a bucket meets only the bucket's smallest, and what is linked becomes
one component. Buckets that still hold several components are settled by size. Classes that share a small one are
verified as pairs, a number in proportion to the table. Classes that large ones connect are a cluster, which is
dealt into blocks of bounded size; a pair of blocks is one group, which counts the common shingles of all its pairs
by a matrix product and returns no more than a spanning forest of the links. Blocks of one and the same component do
not meet. Every candidate pair of different components is so verified exactly. Links found then connect whole
components: the first ones are not walked again.

Sets are compared as 64-bit hashes of their shingles, classes by a 128-bit digest of the set.

Edge cases: null, empty or blank texts have the empty set and link with nothing; repeated rows share their id, set and
component, and one row of them is enough to stand for it; rows of one doc_id with different texts are in the classes of
their texts, and all of them stay if one does; rows without doc_id link with nothing and stay; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import shingles as S
from meterlake.llm.common import NO_ID, ids, short_batches, table, unused, whole, with_nulls
from meterlake.llm.components import components, forest
from meterlake.session import discard, written

WORDS, PERCENT = 5, 80
#: Classes of a bucket up to which its pairs are listed; classes of a block of a cluster; shingles of one matrix product.
SMALL, BLOCK, COLUMNS = 16, 256, 4096
#: Members that are verified against one leader in a group.
GROUP = 256
SKETCH = "doc_id long, n long, digest binary, bands array<long>, bits array<long>"


def _encoded(column: pd.Series) -> list[bytes]:
    return [t.encode() if t else b"" for t in column]


def _sketch(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = S.shingle_sets(_encoded(batch["text"]), words)
        sketch = S.sketches(sets)
        full = [len(s) > 0 for s in sets]
        keys, bit = S.bands(sketch).view(np.int64), S.bits(sketch)
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "digest": [S.digest(s) for s in sets], "bands": [k if x else [] for k, x in zip(keys, full, strict=True)], "bits": list(bit)}
        )


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = S.shingle_sets(_encoded(batch["text"]), words)
        same = [S.digest(s) == bytes(d) for s, d in zip(sets, batch["digest"], strict=True)]
        yield pd.DataFrame({"id": batch["id"], "items": [s.tobytes() for s in sets]})[same]


def _verify(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Linked pairs of a leader (the row without a member) and members."""
    lead = group["member"].isna()
    leaders, members = group[lead], group[~lead]
    if not len(leaders) or not len(members):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    own = np.frombuffer(leaders["items"].iloc[0], np.uint64)
    linked = []
    for items in members["items"]:
        other = np.frombuffer(items, np.uint64)
        if not len(own) or not len(other):
            linked.append(False)
            continue
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        both = int((own[at] == other).sum())
        linked.append(100 * both >= percent * (len(own) + len(other) - both))
    found = members[linked]
    return pd.DataFrame({"a": found["leader"].astype("int64"), "b": found["member"].astype("int64")})


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (leader, member) those whose sets are similar enough. A leader's members are dealt into groups."""
    # Written, so that Spark can split a hot leader's side of the join.
    members = written(pairs.groupBy("leader").agg(F.count("*").alias("m")), "leaders")
    salted = pairs.join(members, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("m") / F.lit(GROUP))).cast("int")).drop("m")
    own = sets.join(salted.select(F.col("leader").alias("id"), "leader", "salt").distinct(), "id").select("leader", "salt", F.lit(None).cast("long").alias("member"), "items")
    others = sets.join(salted.withColumn("id", F.col("member")), "id").select("leader", "salt", "member", "items")
    return own.union(others).groupBy("leader", "salt").applyInPandas(lambda g: _verify(g, percent), "a long, b long")


def plausible(a: str, b: str, percent: int) -> Column:
    """What every linked pair keeps to: sizes within the threshold, and few enough differing bits."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(3)), F.lit(0))
    share = (1 - percent / 100) / 2
    return (100 * small >= percent * large) & (apart <= int(S.T * share + 6 * np.sqrt(S.T * share * (1 - share))))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)), np.int64)

    def marks(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(some)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(some, s), len(some) - 1)
            out[i, at[some[at] == s]] = 1
        return out

    for at in range(0, len(shared), COLUMNS):
        some = shared[at : at + COLUMNS]
        counts += np.rint(marks(a, some) @ marks(b, some).T).astype(np.int64)
    return counts


def _verify_blocks(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between the two blocks of a pair (or within one that meets itself)."""
    left = group[group["side"] == 0]
    right = group[group["side"] == 1] if (group["side"] == 1).any() else left
    if not len(left):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    a, b = ([np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right))
    both = _common(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None] - both
    i, j = np.nonzero(100 * both >= percent * union)
    x, y = left["id"].to_numpy(np.int64)[i], right["id"].to_numpy(np.int64)[j]
    other = x != y
    x, y = forest(x[other], y[other]) if other.any() else (x[:0], y[:0])
    return pd.DataFrame({"a": x, "b": y})


def verified_clusters(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges that connect what the links inside each cluster connect. members: id, part, cluster."""
    sizes = members.groupBy("cluster", "part").agg(F.count("*").alias("m"))
    # A component of its own blocks, or all small ones of a cluster together.
    camp = F.when(F.col("m") >= BLOCK, F.col("part"))
    camps = sizes.groupBy("cluster", camp.alias("camp")).agg(F.ceil(F.sum("m") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(sizes, ["cluster", "part"]).withColumn("camp", camp).alias("d")
    placed = placed.join(camps.alias("k"), (F.col("d.cluster") == F.col("k.cluster")) & F.col("d.camp").eqNullSafe(F.col("k.camp")))
    placed = placed.select("d.id", "d.cluster", F.xxhash64("d.cluster", F.coalesce("d.camp", F.lit(-1)), F.pmod(F.xxhash64("d.id"), "k.blocks")).alias("block"), F.col("d.camp").alias("camp"))
    blocks = placed.select("cluster", "block", "camp").distinct()
    met = blocks.alias("x").join(blocks.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.camp") == F.col("y.camp"), F.lit(False)))
    pair = met.select(F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    sided = pair.select("one", "two", F.lit(0).alias("side"), F.col("one").alias("block")).union(pair.where("one <> two").select("one", "two", F.lit(1).alias("side"), F.col("two").alias("block")))
    rows = placed.join(sets, "id").select("id", "block", "items").join(sided, "block")
    return rows.select("one", "two", "side", "id", "items").groupBy("one", "two").applyInPandas(lambda g: _verify_blocks(g, percent), "a long, b long")


def linked(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """id and component_id (one of its ids) of the classes that links connect; None without candidates.

    classes: id, rep (a doc_id that has it), digest, n, bands, bits. docs: doc_id, text.
    """
    rows = classes.select("id", "n", *(F.col("bits")[i].alias(f"s{i}") for i in range(3)), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    rows = written(rows.join(shared, "key"), "buckets")
    if rows.isEmpty():
        return None
    # Sets of the classes that have a candidate, found again from their texts.
    need = rows.select("id").distinct().join(classes.select("id", "rep", "digest"), "id")
    texts = docs.join(need, F.col("doc_id") == F.col("rep")).select("id", "digest", "text")
    sets = written(texts.mapInPandas(lambda it: _sets(it, words), "id long, items binary").dropDuplicates(["id"]), "sets")

    def plausible_pairs(x: DataFrame, y: DataFrame, test: Column) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & test & plausible("x", "y", percent))
        return met.select(F.col("x.id").alias("leader"), F.col("y.id").alias("member")).distinct()

    # 1. Every class and the smallest of its buckets.
    first = rows.groupBy("key").agg(F.min("id").alias("id"))
    stars = written(plausible_pairs(rows.join(first, ["key", "id"]), rows, F.col("x.id") < F.col("y.id")), "stars")
    edges = written(verified(stars, sets, percent), "verified")
    parts = written(components(edges).select("id", F.col("component").alias("part")), "parts")
    discard(edges)
    # 2. Buckets that hold several components.
    labelled = rows.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    live = labelled.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("m"), F.min("id").alias("least")).where("low <> high")
    labelled = written(labelled.join(live.select("key", "m", "least"), "key"), "labelled")
    discard(rows)
    clusters = components(labelled.where(F.col("m") > SMALL).select(F.col("least").alias("a"), F.col("id").alias("b")))
    members = clusters.select("id", F.col("component").alias("cluster")).join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    found = written(verified_clusters(members, sets, percent), "verified")
    few = labelled.where(F.col("m") <= SMALL)
    pairs = plausible_pairs(few, few, (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part"))).join(stars, ["leader", "member"], "left_anti")
    found = written(found.union(verified(written(pairs, "pairs"), sets, percent)), "verified")
    for table_ in (labelled, stars, sets):
        discard(table_)
    # 3. Links between components.
    ends = found
    for c in ("a", "b"):
        ends = ends.join(parts.toDF(c, f"part_{c}"), c, "left").withColumn(c, F.coalesce(f"part_{c}", c)).select("a", "b")
    upper = components(ends).toDF("part", "component_id")
    both = parts.join(upper, "part", "left").select("id", F.coalesce("component_id", "part").alias("component_id"))
    # Classes that were alone before are parts of their own.
    return both.union(upper.join(parts, upper["part"] == parts["id"], "left_anti").select("part", "component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: set size, class, component and whether it stays."""
    rows = short_batches(docs).select(ids(), whole().alias("text"))
    sketched = written(rows.mapInPandas(lambda it: _sketch(it, words), SKETCH), "sketches")
    known = sketched.where((F.col("doc_id") != NO_ID) & (F.col("n") > 0))
    # Copies fold before the shuffle; the number of a class is fixed once it is written.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id())
    first = written(first, "classes")
    own = known.join(first, "digest").where("doc_id = rep").select("id", "rep", "digest", "n", "bands", "bits").dropDuplicates(["id"])
    found = linked(own, rows, words, percent)
    named = first.select("digest", "rep")
    if found is None:
        named = named.withColumn("component_id", F.col("rep"))
    else:
        joined = written(first.join(found.withColumnRenamed("component_id", "component"), "id").select("id", "rep", "component"), "joined")
        least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = first.join(joined.join(least, "component").select("id", "component_id"), "id", "left").select("digest", "rep", F.coalesce("component_id", "rep").alias("component_id"))
    classed = known.select("doc_id", "n", "digest").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), "component_id")
    rest = with_nulls(sketched.where((F.col("doc_id") == NO_ID) | (F.col("n") == 0)), "doc_id").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return classed.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without the later members of each component, columns as they are."""
    gone_id = unused(docs, "gone_id")
    gone = near_duplicates(docs, words, percent).groupBy(F.col("doc_id").alias(gone_id)).agg(F.bool_or("kept").alias("stays")).where("NOT stays").select(gone_id)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 2 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS items FROM w
), c AS (
  SELECT items, min(doc_id) AS id, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY items
), t AS (
  SELECT id, n, unnest(items) AS item FROM c
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY freq, item) AS place FROM (SELECT *, count(*) OVER (PARTITION BY item) AS freq FROM t)
), rare AS (
  SELECT id, n, item FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1 AND freq > 1
), candidates AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM rare a JOIN rare b ON a.item = b.item AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), linked AS (
  SELECT x, y FROM candidates JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE 100 * len(list_intersect(a.items, b.items)) >= 80 * (a.n + b.n - len(list_intersect(a.items, b.items)))
), edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked), reach(x, y) AS (
  SELECT id, id FROM c UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(c.id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON c.items = s.items LEFT JOIN least ON least.x = c.id
"""
