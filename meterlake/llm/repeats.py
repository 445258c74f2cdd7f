"""Removal of bytes inside repeated strings of a fixed length, by suffix buckets.

Every string of LENGTH bytes belongs to one suffix bucket, named by the hash of its minimizer (the anchor): the GRAM-byte
string of least hash within it. Equal strings have equal minimizers, so a repeat never crosses buckets, and hashes choose
buckets only. Starts that follow each other and share an anchor are one context. Contexts whose anchor is used once have
no repeat and are done without their text; of all others the bytes go to their bucket with their places. There the
different contexts are sorted as suffixes, one bucket at a time, with a difference cover for long ties (suffix_sort);
neighbours that agree over LENGTH bytes are the repeats, and all places of a string but the earliest are covered.
Contexts of equal bytes are sorted once, with all their places, so a copy costs its place only; the run of equal strings
issues the spans of every place.

An anchor that is used more than HOT times would make a bucket of any size. Its contexts are sorted in the same way where
they are cut, some HELD_HOT bytes at a time; of each run of equal strings the later places become spans, and the string
goes on once, with its earliest place, to a group chosen by the string's own bytes, which sorts again what comes from all tasks.
No group holds more than some GROUP contexts, and HOT more for an anchor.

Edge cases: null text is empty; texts shorter than LENGTH keep everything; texts of any size are read in pieces that
overlap by LENGTH - 1; rows that share a doc_id are one document and never cover themselves (what is covered in one of
them is removed from all, as far as they reach, so they should hold one text); rows without doc_id are kept whole and
cover nothing; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import NO_ID, ids, short_batches, table, whole, with_nulls
from meterlake.llm.shingles import U, mix, powers
from meterlake.llm.suffix_sort import V, sorted_buckets
from meterlake.session import discard, written

LENGTH, GRAM = 100, 32
#: Contexts of a group that sorts its buckets on average, and uses of one anchor beyond which its strings are dealt on.
GROUP, HOT = 4_000, 2_000
#: Bytes of a document whose contexts are found at a time, and bits that hold a place among them.
PIECE, PLACE = 1 << 20, 24
#: Bytes of different contexts, and of those of hot anchors, that a task folds before it sends them.
HELD, HELD_HOT = 1 << 23, 1 << 19
VALUES = mix(np.arange(1000, 1256, dtype=U)) | U(1)

CONTEXT = "anchor long, doc_id long, lo int, size int"
SPAN = "doc_id long, start int, stop int"


def contexts(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and byte size of each context of a piece of a document."""
    width, m = length - gram + 1, len(data) - length + 1
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(VALUES[data] * up, dtype=U)])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    low = U((1 << PLACE) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=U)
    # The least key of every window of starts, from running minima of blocks to either side.
    blocks = np.concatenate([key, np.full(-len(key) % width, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)
    lo = np.flatnonzero(np.diff(place, prepend=-1))
    return hashes[place[lo]], lo, np.append(lo[1:], m) - lo + length - 1


def _contexts(batches: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    def frame(found: list[tuple]) -> pd.DataFrame:
        anchor, doc_id, lo, size = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"anchor": anchor.view(np.int64), "doc_id": doc_id, "lo": lo, "size": size})

    for batch in batches:
        found, held = [], 0
        for doc_id, raw in zip(batch["doc_id"], batch["data"], strict=True):
            data = np.frombuffer(raw, np.uint8)
            for at in range(0, len(raw) - length + 1 if doc_id != NO_ID else 0, PIECE):
                anchor, lo, size = contexts(data[at : at + PIECE + length - 1], length, gram)
                found.append((anchor, np.full(len(lo), doc_id), lo + at, size))
                held += len(lo)
                if held > 1 << 18:
                    yield frame(found)
                    found, held = [], 0
        if found:
            yield frame(found)


class Kinds:
    """Different byte strings in the order of their first use, and all places of each."""

    def __init__(self) -> None:
        self.kinds: dict[bytes, int] = {}
        self.held = 0
        self.kind: list[int] = []
        self.docs: list[int] = []
        self.los: list[int] = []

    def add(self, doc_id: int, lo: int, data: bytes) -> bool:
        """Whether these bytes are new."""
        n = len(self.kinds)
        self.kind.append(self.kinds.setdefault(data, n))
        self.docs.append(doc_id)
        self.los.append(lo)
        self.held += len(data) if len(self.kinds) > n else 0
        return len(self.kinds) > n

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, document and start of all places, kind by kind."""
        kind, docs, los = (np.array(x, np.int64) for x in (self.kind, self.docs, self.los))
        by = np.argsort(kind, kind="stable")
        return kind[by], docs[by], los[by]


class Fold:
    """Contexts of equal bytes once, with their places; those of hot anchors are sorted here and only leading strings sent."""

    COLUMNS = ("bucket", "data", "docs", "los")

    def __init__(self, length: int) -> None:
        self.length = length
        self._clear()

    def _clear(self) -> None:
        self.cold, self.hot = Kinds(), Kinds()
        self.buckets: list[int] = []
        self.groups = 1

    def add(self, bucket: int, doc_id: int, lo: int, data: bytes) -> None:
        if self.cold.add(doc_id, lo, data):
            self.buckets.append(bucket)

    def add_hot(self, groups: int, doc_id: int, lo: int, data: bytes) -> None:
        """A context whose strings are dealt into so many groups."""
        self.groups = groups
        self.hot.add(doc_id, lo, data)

    def full(self) -> bool:
        return self.cold.held > HELD or self.hot.held > HELD_HOT or len(self.cold.kind) + len(self.hot.kind) > HELD // 32

    def rows(self) -> pd.DataFrame:
        """What the groups get: bytes with the places they start at; without bytes, the documents and bounds of spans that are found already."""
        kind, docs, los = self.cold.places()
        ends = [0, *(np.cumsum(np.bincount(kind, minlength=len(self.cold.kinds))) * 8).tolist()] if len(kind) else [0]
        docs, los = docs.tobytes(), los.tobytes()
        rows = [(b, x, docs[a:e], los[a:e]) for b, x, a, e in zip(self.buckets, self.cold.kinds, ends, ends[1:], strict=False)]
        if self.hot.kinds:
            found, leads = sorted_spans(list(self.hot.kinds), *self.hot.places(), self.length)
            number = lambda x: int(x).to_bytes(8, "little", signed=True)
            deal = lambda x: -1 - int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big") % self.groups
            rows += [(deal(x), x, number(d), number(i)) for x, d, i in leads]
            docs, start, stop = found
            group = (docs + start) % self.groups
            by = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[by])) + 1
            rows += [(-1 - int(group[i[0]]), None, docs[i].tobytes(), np.stack([start[i], stop[i]], axis=1).tobytes()) for i in np.split(by, cuts) if len(i)]
        self._clear()
        return pd.DataFrame(rows, columns=self.COLUMNS)


def _cut(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The bytes of the shared contexts of each document; a negative bucket says into how many groups to deal the strings."""
    fold = Fold(length)
    for batch in batches:
        for doc_id, raw, places in zip(batch["doc_id"], batch["data"], batch["places"], strict=True):
            for p in places:
                lo, data = p["lo"], raw[p["lo"] : p["lo"] + p["size"]]
                # Shorter than a string: a place of another row with this doc_id.
                if len(data) >= length:
                    fold.add(p["bucket"], doc_id, lo, data) if p["bucket"] >= 0 else fold.add_hot(-p["bucket"], doc_id, lo, data)
            if fold.full():
                yield fold.rows()
    yield fold.rows()


def _runs(marked: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the marked suffixes that follow each other in one kind."""
    joined = marked[1:] & marked[:-1] & (owner[1:] == owner[:-1])
    return np.flatnonzero(marked & ~np.concatenate([[False], joined])), np.flatnonzero(marked & ~np.concatenate([joined, [False]]))


def sorted_spans(kinds: list[bytes], kind: np.ndarray, docs: np.ndarray, lo: np.ndarray, length: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[bytes, int, int]]]:
    """What the suffix order of the kinds tells: spans (document, start, stop), and each string with its earliest place.

    kind, docs, lo: the places of the kinds, at least one of each. Suffixes that agree over length bytes are side by side;
    such a run has all places of its members' kinds, and issues spans at all of them but the earliest.
    """
    by = np.lexsort((lo, docs, kind))
    kind, docs, lo = kind[by], docs[by], lo[by]
    # A repeated row is the same place again.
    new = np.append(True, (np.diff(kind) != 0) | (np.diff(docs) != 0) | (np.diff(lo) != 0))
    kind, docs, lo = kind[new], docs[new], lo[new]
    head = np.flatnonzero(np.diff(kind, prepend=-1))
    uses = np.diff(np.append(head, len(kind)))
    sizes = np.array([len(x) for x in kinds])
    text = np.frombuffer(b"".join(kinds) + bytes(3 * length + 4 * V), np.uint8)
    starts, n = np.cumsum(sizes) - sizes, sizes - length + 1
    owner = np.repeat(np.arange(len(kinds)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    suffixes = starts[owner] + inside
    who = np.empty(len(text), np.int64)
    who[suffixes] = np.arange(len(suffixes))
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    # Of each suffix, at its kind's earliest place: whether its string starts earlier, starts twice, starts here first.
    later, twice, first = (np.zeros(len(suffixes), bool) for _ in range(3))
    for order in sorted_buckets(text, int(sizes.sum()), suffixes, length):
        same = np.zeros(len(order), bool)
        for a in range(1, len(order), 1 << 16):
            b = min(len(order), a + (1 << 16))
            same[a:b] = (strings[order[a:b]] == strings[order[a - 1 : b - 1]]).all(axis=1)
        run = np.cumsum(~same)
        k = who[order]
        by = np.lexsort((lo[head][owner[k]] + inside[k], docs[head][owner[k]], run))
        k, run = k[by], run[by]
        d, begin = docs[head][owner[k]], lo[head][owner[k]] + inside[k]
        top = np.flatnonzero(np.diff(run, prepend=-1))
        members = np.diff(np.append(top, len(run)))
        lead = np.repeat(top, members)
        later[k] = (d != d[lead]) | (begin != begin[lead])
        twice[k] = np.repeat(np.add.reduceat(uses[owner[k]], top), members) > 1
        first[k[top]] = True
    a, z = _runs(later, owner)
    spans = [(docs[head][owner[a]], lo[head][owner[a]] + inside[a], lo[head][owner[a]] + inside[z] + length)]
    # The further places of a kind get the runs of its strings that start twice.
    a, z = _runs(twice, owner)
    copy = np.setdiff1d(np.arange(len(kind)), head, assume_unique=True)
    at = np.searchsorted(owner[a], kind[copy])
    many = np.searchsorted(owner[a], kind[copy], side="right") - at
    copy, at = np.repeat(copy, many), np.repeat(at, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    spans.append((docs[copy], lo[copy] + inside[a[at]], lo[copy] + inside[z[at]] + length))
    leads = ((kinds[o][i : i + length], docs[head[o]], lo[head[o]] + i) for o, i in zip(owner[first].tolist(), inside[first].tolist(), strict=True))
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True)), leads


def _sort_group(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """The spans of a group's strings at all their places but the earliest."""
    done = group["data"].isna().to_numpy()
    numbers = lambda column: np.frombuffer(b"".join(column), np.int64)
    some, bounds = numbers(group["docs"][done]), numbers(group["los"][done]).reshape(-1, 2)
    spans = [(some, bounds[:, 0], bounds[:, 1])]
    group = group[~done]
    if len(group):
        kinds: dict[bytes, int] = {}
        row = np.array([kinds.setdefault(x, len(kinds)) for x in map(bytes, group["data"])])
        kind = np.repeat(row, [len(x) // 8 for x in group["docs"]])
        spans.append(sorted_spans(list(kinds), kind, numbers(group["docs"]), numbers(group["los"]), length)[0])
    return pd.DataFrame(dict(zip(("doc_id", "start", "stop"), map(np.concatenate, zip(*spans, strict=True)), strict=True)))


def shared_contexts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The contexts of anchors that are used more than once, with the anchor's uses. docs: doc_id (NO_ID for none), data."""
    found = written(docs.mapInPandas(lambda it: _contexts(it, length, gram), CONTEXT), "contexts")
    # Uses are summed before they move. They are written, so that Spark can split a hot anchor's side of the join.
    uses = written(found.groupBy("anchor").agg(F.count("*").alias("uses")).where("uses > 1"), "uses")
    shared = written(found.join(uses, "anchor"), "shared")
    discard(found)
    discard(uses)
    return shared


def dealt(docs: DataFrame, shared: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """What the groups sort: bucket, data and its places (docs, los); without data a span that is covered already."""
    is_hot = F.col("uses") > hot
    n_contexts, n_strings = shared.agg(F.count_if(~is_hot), F.sum(F.when(is_hot, F.col("size").cast("long") - length + 1))).first()
    groups, hot_groups = max(1, n_contexts // GROUP), max(1, (n_strings or 0) // (GROUP * 8))
    # The strings of hot anchors are dealt by their own bytes: a negative bucket says into how many groups.
    bucket = F.when(is_hot, F.lit(-hot_groups)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    places = shared.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "size", bucket.cast("long").alias("bucket"))).alias("places"))
    return docs.join(places, "doc_id").select("doc_id", "data", "places").mapInPandas(lambda it: _cut(it, length), "bucket long, data binary, docs binary, los binary")


def spans(docs: DataFrame, shared: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The spans of each document whose strings all start earlier somewhere. docs: doc_id (not null), data (binary)."""
    return dealt(docs, shared, length, hot).groupBy("bucket").applyInPandas(lambda g: _sort_group(g, length), SPAN)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, raw, found in zip(batch["doc_id"], batch["data"], batch["spans"], strict=True):
            kept, removed, runs = raw, 0, 0
            if found is not None and len(found):
                at = np.array([(s["start"], s["stop"]) for s in found])
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, np.minimum(at[:, 0], len(raw)), 1)
                np.add.at(change, np.minimum(at[:, 1], len(raw)), -1)
                gone = np.cumsum(change[:-1]) > 0
                removed, runs = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Per document the counts of what is removed, and the bytes that remain (their digest; the bytes if asked for)."""
    rows = short_batches(docs).select(ids(), whole().cast("binary").alias("data"))
    # Texts move once: both joins read one exchange by doc_id.
    found = spans(rows, shared_contexts(rows, length, gram), length, hot)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return with_nulls(rows.join(found, "doc_id", "left").select("doc_id", "data", "spans").mapInPandas(lambda it: _remove(it, with_text), OUT), "doc_id")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP8_SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, h, len(h) // 2 AS n FROM b
), strings AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS place
  FROM (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM s WHERE n >= 100))
), later AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM strings WHERE place > 1
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, coalesce(max(z), 0), max(n) FROM s LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * pieces.a + 1, 2 * (pieces.z - pieces.a)), '' ORDER BY pieces.a) AS x FROM pieces JOIN s USING (doc_id) GROUP BY doc_id
), totals AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM s JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""
