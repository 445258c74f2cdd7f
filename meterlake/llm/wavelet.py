"""Token ids in wavelet-matrix shards, written and read by Spark as compressed Parquet files.

A shard holds the ids of consecutive documents as 16 (or as many as the vocabulary needs) bit-planes, highest
first; after each plane the ids are dealt stably into those with a 0 bit and those with a 1 bit. Rank samples every
SAMPLE bits make access, counting and search for the k-th occurrence of a token cheap without decoding the shard:
access(), count(), occurrences() and find() answer them for a whole folder from its files, shard by shard.

Edge cases: a null or empty text is a document of the end id alone; documents with equal doc_id stay side by side in
text order; extra columns are not read; an empty table gives an empty result. A document is never cut: a shard
closes after the document that fills it, so its size is bounded by SHARD_TOKENS and the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import encoder
from meterlake.llm.common import ids as id_column
from meterlake.llm.common import short_batches, table, whole, with_nulls
from meterlake.session import shared_folder

SHARD_TOKENS = 1 << 20
#: Bits between two rank samples; a multiple of 8.
SAMPLE = 4096
END_ID = 2


class WaveletMatrix:
    """Succinct sequence of ids: planes are packed bits, zeros their counts of 0 bits, ranks sampled counts of 1 bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.planes = n, zeros, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, zeros, planes, ranks = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        for k in reversed(range(bits)):
            bit = (now & now.dtype.type(1 << k)) != 0
            plane = np.packbits(bit, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), SAMPLE // 8), dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
            planes.append(plane.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32).tobytes())
            low = now.compress(~bit)
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(bit)])
        return cls(len(ids), zeros, planes, ranks)

    def _rank1(self, k: int, i: int) -> int:
        """1 bits before place i of plane k."""
        block = i // SAMPLE
        at = block * SAMPLE // 8
        part = self.planes[k][at : (i + 7) // 8]
        extra = int(np.bitwise_count(part).sum()) if len(part) else 0
        if i % 8:
            extra -= int(self.planes[k][i // 8] >> (i % 8)).bit_count()
        return int(self.ranks[k][block]) + extra

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of this value in plane k."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank1(k, middle + 1)
            if (ones if bit else middle + 1 - ones) > j:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8] >> (i % 8)) & 1
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in places start to end."""
        end = self.n if end is None else end
        for k in range(len(self.planes)):
            a, b = self._rank1(k, start), self._rank1(k, end)
            bit = token >> (len(self.planes) - 1 - k) & 1
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if bit else (start - a, end - b)
        return end - start

    def find(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of an id; -1 if there are fewer."""
        if j >= self.count(token):
            return -1
        start = 0
        for k in range(len(self.planes)):
            ones = self._rank1(k, start)
            start = self.zeros[k] + ones if token >> (len(self.planes) - 1 - k) & 1 else start - ones
        i = start + j
        for k in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the deals of the planes undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            back[np.flatnonzero(bit)] = now[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            now = back
        return now.astype(np.uint32)


SHARD = "part int, seq int, start long, first_doc long, n_tokens long, doc_ids binary, doc_lengths binary, zeros array<long>, planes array<binary>, ranks array<binary>"


def _shards(batches: Iterator[pd.DataFrame], path: str, end_id: int, bits: int, shard_tokens: int) -> Iterator[pd.DataFrame]:
    words, part = encoder(path), TaskContext.get().partitionId()
    docs: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = seq = start = 0

    def closed() -> pd.DataFrame:
        flat = np.concatenate(ids)
        m, who, n = WaveletMatrix.build(flat, bits), np.concatenate(docs), np.concatenate(lengths)
        row = (part, seq, start, int(who[0]), len(flat), who.tobytes(), n.tobytes(), m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks])
        return pd.DataFrame([row], columns=[x.split()[0] for x in SHARD.split(", ")])

    for batch in batches:
        for at in range(0, len(batch), 100):
            some = batch.iloc[at : at + 100]
            flat, counts = words.encode_ended(some["text"].tolist(), end_id)
            ids.append(flat)
            lengths.append(counts.astype(np.int64))
            docs.append(some["doc_id"].to_numpy(np.int64))
            held += len(ids[-1])
            if held >= shard_tokens:
                yield closed()
                seq, start, held = seq + 1, start + held, 0
                docs, ids, lengths = [], [], []
    if held:
        yield closed()


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes doc_id, text in ascending doc_id order; each range of doc_id becomes one file of shards."""
    spark = docs.sparkSession
    bits = int(max(encoder(path).library.get_vocab_size() - 1, end_id)).bit_length()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = short_batches(docs).select(id_column(), whole().alias("text")).repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(lambda it: _shards(it, path, end_id, bits, shard_tokens), SHARD).write.option("compression", "zstd").parquet(folder)


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            ids = open_shard(row).decode()
            lengths = np.frombuffer(row.doc_lengths, np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": np.frombuffer(row.doc_ids, np.int64), "start": row.start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder, each with the place of its first id among all ids.

    The starts of the ranges come from one total per range (a few numbers for each output file).
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    totals = sorted((r["first_doc"], r["part"], r["n"]) for r in shards.groupBy("part").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for *_, n in totals)]).tolist()
    bases = spark.createDataFrame([(p, b) for (_, p, _), b in zip(totals, before, strict=False)], "part int, base long")
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start")).drop("base")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: its place among all ids, its length and the checksum of its ids."""
    shards = stored(spark, folder).select("start", "n_tokens", "doc_ids", "doc_lengths", "zeros", "planes", "ranks")
    return with_nulls(shards.mapInPandas(_documents, DOCUMENT), "doc_id")


def open_shard(row: NamedTuple) -> WaveletMatrix:
    """The matrix of a stored shard, over its compressed bytes as they are."""
    return WaveletMatrix(row.n_tokens, list(row.zeros), list(row.planes), list(row.ranks))


def count(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """How often each of the tokens occurs in all documents, by ranks: token, n."""

    tokens = sorted(set(tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                m = open_shard(row)
                yield pd.DataFrame({"token": tokens, "n": [m.count(t) for t in tokens]})

    return stored(spark, folder).mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """All places of each of the tokens, by selects: token, place."""

    tokens = sorted(set(tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                m = open_shard(row)
                found = [(t, row.start + m.find(t, j)) for t in tokens for j in range(m.count(t))]
                yield pd.DataFrame(found, columns=["token", "place"])

    return stored(spark, folder).mapInPandas(run, "token long, place long")


def find(spark: SparkSession, folder: str, token: int, j: int) -> int | None:
    """Place of the j-th (from 0) occurrence of a token among all ids; None if there are fewer.

    Counts are summed by file, so the driver sees one number of each; then the shards of one file are looked at.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": batch["part"], "start": batch["start"], "n": [open_shard(r).count(token) for r in batch.itertuples()]})

    shards = stored(spark, folder)
    found = shards.mapInPandas(counts, "part int, start long, n long")
    for r in sorted(found.groupBy("part").agg(F.min("start").alias("start"), F.sum("n").alias("n")).collect(), key=lambda r: r["start"]):
        if j < r["n"]:
            for shard in found.where(F.col("part") == r["part"]).orderBy("start").toLocalIterator():
                if j < shard["n"]:
                    row = shards.where((F.col("part") == r["part"]) & (F.col("start") == shard["start"])).first()
                    return row["start"] + open_shard(row).find(token, j)
                j -= shard["n"]
        j -= r["n"]
    return None


def access(spark: SparkSession, folder: str, places: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The token at each place (column place) among all ids, without decoding a shard: place, token. Places outside give no row."""
    shards = stored(spark, folder)
    # A place meets its shard in a cell of shard_tokens ids.
    end = F.col("start") + F.col("n_tokens")
    cells = shards.select("part", "seq", "start", end.alias("end"), F.explode(F.sequence(F.expr(f"start div {shard_tokens}"), F.expr(f"(start + n_tokens - 1) div {shard_tokens}"))).alias("cell"))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("cell", F.expr(f"place div {shard_tokens}"))
    asked = asked.join(cells, "cell").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))).select("part", "seq", "place")

    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"place": [], "token": []}, dtype="int64")
        (row,) = shard.itertuples()
        m = open_shard(row)
        return pd.DataFrame({"place": asked["place"], "token": [m.access(p - row.start) for p in asked["place"].tolist()]})

    return asked.groupBy("part", "seq").cogroup(shards.toDF(*shards.columns).groupBy("part", "seq")).applyInPandas(run, "place long, token long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "op3")
    write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)
