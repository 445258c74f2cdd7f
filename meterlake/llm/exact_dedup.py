"""Exact duplicates by a minimal perfect hash over the digests of a history.

The history's distinct digests are dealt by hash into shards of bounded size. Each shard is a minimal perfect hash:
levels of bit arrays, each of which places the digests that are alone at their place, and whose ranks number the
slots 0..n-1 without gaps. A slot holds the full digest and the locator of its winner, so a lookup is one place and
a comparison of 32 bytes. New documents are reduced to distinct digests before they look up; members join the
historical winner, the others are grouped among themselves.

Edge cases: null text counts as empty; empty texts are copies of one another; of repeated rows (same doc_id and text)
one stays; a null doc_id wins only in a group without any other; extra columns do not count; an empty history or an
empty table gives groups of the new rows alone, or none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.common import NO_ID, short_batches, table, unused, whole
from meterlake.session import written

#: Digests of a shard on average; places for each digest of a level.
SHARD_DIGESTS, ROOM = 8192, 2

INDEX = "shard int, levels array<binary>, digests binary, winners binary, rows binary, counts binary"
GROUPS = "digest binary, keep_id long, keep_row long, group_size long, historical boolean"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest (rows of 32 bytes)."""
    w = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    return w[:, 1], w[:, 2]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each digest."""
    a, b = _words(digests)
    levels, slots, left, base = [], np.empty(len(digests), np.int64), np.arange(len(digests)), 0
    while len(left):
        size = max(64, ROOM * len(left))
        place = _place(a[left], b[left], len(levels), size)
        bits = np.bincount(place, minlength=size) == 1
        alone = bits[place]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[place[alone]]
        base, left = base + int(bits.sum()), left[~alone]
        levels.append(bits)
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The only slot that each digest can have; -1 for digests that no level takes."""
    a, b = _words(digests)
    slots, left, base = np.full(len(digests), -1), np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        place = _place(a[left], b[left], k, len(bits))
        here = bits[place]
        slots[left[here]] = base + (np.cumsum(bits) - 1)[place[here]]
        base, left = base + int(bits.sum()), left[~here]
    return slots


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _bytes(group["digest"])
    levels, slots = build_levels(digests)
    order = np.argsort(slots)
    cells = [group[c].to_numpy(np.int64)[order].tobytes() for c in ("winner", "row", "n")]
    bits = [np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in levels]
    return pd.DataFrame([(group["shard"].iloc[0], bits, digests[order].tobytes(), *cells)], columns=[x.split()[0] for x in INDEX.split(", ")])


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if len(index):
        (shard,) = index.itertuples()
        levels = [np.unpackbits(np.frombuffer(x[8:], np.uint8), count=int(np.frombuffer(x[:8], np.int64)[0])).view(bool) for x in shard.levels]
        held = np.frombuffer(shard.digests, np.uint8).reshape(-1, 32)
        winners, rows, counts = (np.frombuffer(x, np.int64).copy() for x in (shard.winners, shard.rows, shard.counts))
    else:
        levels, held, (winners, rows, counts) = [], np.zeros((0, 32), np.uint8), (np.zeros(0, np.int64) for _ in range(3))
    asked = _bytes(new["digest"])
    slots = find_slots(levels, asked)
    member = slots >= 0
    member[member] = (held[slots[member]] == asked[member]).all(axis=1)
    sizes = new["n"].to_numpy(np.int64)
    counts[slots[member]] += sizes[member]
    old = pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": winners, "keep_row": rows, "group_size": counts, "historical": True})
    own = new[~member]
    fresh = pd.DataFrame({"digest": own["digest"], "keep_id": own["winner"], "keep_row": own["row"], "group_size": own["n"], "historical": False})
    return pd.concat([x for x in (old, fresh) if len(x)] or [old])


def _distinct(keyed: DataFrame, shards: int) -> DataFrame:
    """Digests with their winner and count: partial sums come before the shuffle."""
    best = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row")).alias("best")
    found = keyed.groupBy("digest").agg(best, F.count("*").alias("n"))
    return found.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", F.col("best.doc_id").alias("winner"), F.col("best.row").alias("row"), "n")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of the history's digests."""
    return _distinct(history, shards).groupBy("shard").applyInPandas(_build, INDEX)


def groups(keyed: DataFrame, history: Column) -> DataFrame:
    """Every distinct digest of both sides with its winner and size.

    keyed: doc_id, row, digest. history: which rows came before the others.
    """
    old = F.coalesce(history, F.lit(False))
    shards = max(1, keyed.count() // SHARD_DIGESTS)
    index = build_index(short_batches(keyed).where(old), shards)
    new = _distinct(keyed.where(~old), shards)
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, GROUPS)


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, a row number and the digest of the normalised text, as a written table of some 50 bytes a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return written(rows, "digests")


def decide(docs: DataFrame) -> DataFrame:
    """One row per document: which row of its group stays. The lower half of the ids is the history."""
    keyed = keyed_documents(docs)
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    found = groups(keyed, F.col("doc_id") <= (low + high) // 2 if low is not None else F.lit(False))
    return (
        keyed.join(found, "digest")
        .select(
            "doc_id",
            F.when(F.col("keep_id") < (1 << 63) - 1, F.col("keep_id")).alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "historical",
        )
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without later copies, columns as they are. Of rows repeated with other columns the least by hash stays.

    Texts move once: the join and the choice among repeated rows have the same keys.
    """
    digest, key, place = (unused(docs, c) for c in ("digest", "key", "place"))
    stay = decide(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.unhex("text_sha256").alias(digest))
    marked = docs.withColumns({digest: F.unhex(F.sha2(normalised(), 256)), key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})
    own = Window.partitionBy(key, digest).orderBy(F.xxhash64(*docs.columns))
    met = marked.join(stay, [key, digest], "left_semi").withColumn(place, F.row_number().over(own))
    return met.where(F.col(place) == 1).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), bounds AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS cut FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256,
       min(doc_id) OVER (PARTITION BY text_sha256) <= cut AS historical
FROM keyed, bounds
"""
