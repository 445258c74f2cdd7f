"""Packing of documents into fixed windows by minimum bin slack.

A document longer than the window is cut into whole windows and a rest. Rests wait in a bounded pool; for each
window the longest rest is taken and a bitset subset-sum over the counted remaining lengths picks the multiset that
leaves the least slack, its counts found by walking the bitsets back. A multiset that fits is used as often as the
counts allow. Slack that no multiset closes is filled by cutting one waiting rest, so only the last window of a
partition is short.

Edge cases: a null or empty text is the end id alone; repeated rows are packed once each; extra columns are not
read; an empty table gives an empty result. Work stays in the partition that read the document: no shuffle.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import encoder
from meterlake.llm.common import ids, short_batches, table, whole, with_nulls

WINDOW = 1024
#: Rests that wait before windows are filled from them.
POOL = 8192
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Piece(NamedTuple):
    doc_id: int
    start: int
    doc_tokens: int
    ids: np.ndarray


def least_slack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to the capacity as possible, not above."""
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, times = min(counts[length], capacity // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << (length * times) & mask
            left, times = left - times, times * 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += times
            total -= length * times
    return dict(taken)


class Pool:
    """Rests by length."""

    def __init__(self, window: int) -> None:
        self.window, self.rests, self.size = window, defaultdict(list), 0

    def add(self, piece: Piece) -> None:
        self.rests[len(piece.ids)].append(piece)
        self.size += 1

    def _take(self, length: int) -> Piece:
        self.size -= 1
        piece = self.rests[length].pop()
        if not self.rests[length]:
            del self.rests[length]
        return piece

    def windows(self, until: int) -> Iterator[list[Piece]]:
        """Filled windows until at most so many rests wait."""
        while self.size > until:
            longest = max(self.rests)
            counts = {n: len(x) for n, x in self.rests.items()}
            counts[longest] -= 1
            chosen = least_slack(counts, self.window - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.window - sum(n * k for n, k in chosen.items())
            for _ in range(1 if slack else min(len(self.rests[n]) // k for n, k in chosen.items())):
                pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
                if slack and (longer := [n for n in self.rests if n > slack]):
                    rest = self._take(min(longer))
                    pieces.append(rest._replace(ids=rest.ids[:slack]))
                    self.add(rest._replace(ids=rest.ids[slack:], start=rest.start + slack))
                yield pieces


def _pack(batches: Iterator[pd.DataFrame], path: str, end_id: int, window: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    words, pool, next_id = encoder(path), Pool(window), TaskContext.get().partitionId() << 40

    def rows(sequences: Iterator[list[Piece]]) -> list[tuple]:
        nonlocal next_id
        out = []
        for pieces in sequences:
            offset = 0
            for p in pieces:
                out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, next_id, offset, p.ids.tobytes() if with_ids else None))
                offset += len(p.ids)
            next_id += 1
        return out

    for batch in batches:
        for at in range(0, len(batch), 100):
            some = batch.iloc[at : at + 100]
            flat, counts = words.encode_ended(some["text"].tolist(), end_id)
            ends, whole_windows = np.cumsum(counts), []
            for doc_id, end, n in zip(some["doc_id"].tolist(), ends.tolist(), counts.tolist(), strict=True):
                ids, cut = flat[end - n : end], n - n % window
                whole_windows += [[Piece(doc_id, i, n, ids[i : i + window])] for i in range(0, cut, window)]
                if cut < n:
                    pool.add(Piece(doc_id, cut, n, ids[cut:].copy()))
            yield pd.DataFrame(rows(iter(whole_windows)), columns=NAMES)
            if pool.size > POOL:
                yield pd.DataFrame(rows(pool.windows(POOL // 2)), columns=NAMES)
    yield pd.DataFrame(rows(pool.windows(0)), columns=NAMES)


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents with their checksums, their places in the sequences and, if asked for, their ids (32-bit little-endian)."""
    rows = short_batches(docs).select(ids(), whole().alias("text"))
    found = with_nulls(rows.mapInPandas(lambda it: _pack(it, path, end_id, window, with_ids), PIECE), "doc_id")
    return found if with_ids else found.drop("ids")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
