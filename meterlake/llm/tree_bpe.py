"""Exact encoding and decoding of texts of any length by tree concatenation.

A text is halved until its parts are short; the parts are encoded on their own and joined pairwise up the tree. At a
join, the words around it are split again in a window that doubles until it meets a word boundary of either side
beyond the words that the cut can have changed; from there on both sides agree with the whole text, because the
split reads from left to right and looks ahead by less than two words. A single word that is very long is halved in
the same way on its byte symbols: around each join a growing window of ids is merged again until the pairs of ids at
both of its edges, merged alone, stay as they are, which is when a sequence of merges is that of the whole word.

Texts above SPREAD code points are halved into rows that Spark deals to other tasks; the rest stay in their partition.
The parts of one text meet again in one task, which joins them: a task holds one text, its words' lengths and its ids. A
long text that holds the string of a special token stays in its partition, halved between those strings.

Edge cases: null or empty text has no ids and empty decoded text; repeated rows give repeated results; extra columns
are not read; an empty table gives an empty result. The string of a special token becomes its id, as in the library.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import BYTE_SYMBOLS, Encoder, encoder
from meterlake.llm.common import ids, short_batches, table, whole, with_nulls

#: Code points of a part of a text, of a part that is a row of its own, and bytes of a word that is encoded whole.
LEAF, SPREAD, UNSPLIT = 1 << 14, 1 << 16, 1 << 9


class Part(NamedTuple):
    """A piece of text with its words' lengths (code points), their counts of ids, and the ids."""

    text: str
    chars: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class TreeEncoder:
    def __init__(self, words: Encoder, leaf: int = LEAF, unsplit: int = UNSPLIT) -> None:
        self.words, self.leaf, self.unsplit = words, leaf, unsplit
        self.symbols = {b: chr(c) for b, c in BYTE_SYMBOLS.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, words.special)) + ")") if words.special else None
        back = {s: b for b, s in self.symbols.items()}
        vocabulary = words.library.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    # Words

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        words = self.words.split(text)
        if words is not None:
            return words
        return [text[a:b] for _, (a, b) in self.words.library.pre_tokenizer.pre_tokenize_str(text)]

    def _merged(self, symbols: str) -> list[int]:
        return [t.id for t in self.words.library.model.tokenize(symbols)]

    def _symbols(self, ids: list[int]) -> str:
        return "".join(self.symbols[b] for i in ids for b in self.bytes_of[i])

    def _kept(self, pair: list[int]) -> bool:
        return len(pair) < 2 or self._merged(self._symbols(pair)) == pair

    def long_word(self, symbols: str) -> list[int]:
        """Ids of the byte symbols of one word."""
        if len(symbols) <= self.unsplit:
            return self._merged(symbols)
        middle = len(symbols) // 2
        left, right = self.long_word(symbols[:middle]), self.long_word(symbols[middle:])
        if self._kept([left[-1], right[0]]):
            return left + right
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self._merged(self._symbols(left[a:] + right[:b]))
            if self._kept([*left[:a][-1:], window[0]]) and self._kept([window[-1], *right[b:][:1]]):
                return left[:a] + window + right[b:]
            reach *= 2

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids of each word, and the ids."""
        w = self.words
        if not any(len(x) > self.unsplit for x in words):
            at = w.look_up(words)
            return w.lengths[at].astype(np.int64), w._flat(at)
        ids = [np.array(self.long_word("".join(self.symbols[b] for b in x.encode())), np.uint32) if len(x) > self.unsplit else self.of_words([x])[1] for x in words]
        return np.array([len(x) for x in ids], np.int64), np.concatenate(ids)

    # Texts

    def part(self, text: str) -> Part:
        words = self.split(text)
        counts, ids = self.of_words(words)
        return Part(text, np.fromiter(map(len, words), np.int64, len(words)), counts, ids)

    def join(self, left: Part, right: Part) -> Part:
        """The part for both texts, one after the other."""
        if not left.text or not right.text:
            return left if left.text else right
        reach, total = 4, len(left.text) + len(right.text)
        left_ends, right_ends = np.cumsum(left.chars), np.cumsum(right.chars)
        while True:
            a, b = max(0, len(left.chars) - reach), min(len(right.chars), reach)
            start = int(left_ends[a - 1]) if a else 0
            end = int(right_ends[b - 1])
            words = self.split(left.text[start:] + right.text[:end])
            bounds = np.cumsum([len(x) for x in words]) + start
            if b == len(right.chars):
                keep, resume = len(words), b  # the window holds the whole right side
                break
            # Boundaries that both have, apart from those that the window's own end can have made.
            common = np.intersect1d(bounds[:-2], right_ends[: max(0, b - 2)] + len(left.text))
            if len(common):
                keep, resume = int(np.searchsorted(bounds, common[0])) + 1, int(np.searchsorted(right_ends, common[0] - len(left.text))) + 1
                break
            reach *= 2
        counts, ids = self.of_words(words[:keep])
        before, after = int(left.counts[:a].sum()), int(right.counts[:resume].sum())
        chars = np.fromiter((len(x) for x in words[:keep]), np.int64, keep)
        joined = Part(left.text + right.text, np.concatenate([left.chars[:a], chars, right.chars[resume:]]), np.concatenate([left.counts[:a], counts, right.counts[resume:]]), np.concatenate([left.ids[:before], ids, right.ids[after:]]))
        assert int(joined.chars.sum()) == total, "a join must keep every code point"
        return joined

    def tree(self, parts: list[Part]) -> Part:
        """Neighbours joined until one part is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for piece in self.special.split(text) if self.special and any(s in text for s in self.words.special) else [text]:
            if piece in self.words.special:
                out.append(np.array(self.words.library.encode(piece, add_special_tokens=False).ids, np.uint32))
            elif piece:
                out.append(self.tree([self.part(x) for x in halves(piece, self.leaf)]).ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def halves(text: str, leaf: int) -> list[str]:
    """The text, halved until no part is longer than a leaf."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(encoder(path))


def _said(ids: np.ndarray, tree: TreeEncoder) -> tuple[int, str, str]:
    decimal = ",".join(map(str, ids.tolist()))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(tree.decode(ids).encode()).hexdigest()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NAMES = [x.split()[0] for x in DIGEST.split(", ")]


def _short(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    tree = tree_encoder(path)
    for batch in batches:
        rows = []
        for at in range(0, len(batch), 100):
            tree.words.trim()
            some = batch.iloc[at : at + 100]
            texts = some["text"].tolist()
            # Texts of one leaf go to the library together; longer ones up the tree.
            single = [t if len(t) <= tree.leaf else "" for t in texts]
            flat, counts = tree.words.encode(single)
            ends = np.cumsum(counts)
            rows += [(d, *_said(flat[e - n : e] if s is t else tree.encode(t), tree)) for d, t, s, e, n in zip(some["doc_id"].tolist(), texts, single, ends.tolist(), counts.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=NAMES)


PART = "row long, doc_id long, n int, text string, chars binary, counts binary, ids binary"


def _spread(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    tree = tree_encoder(path)
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            tree.words.trim()
            p = tree.tree([tree.part(x) for x in halves(r.text, tree.leaf)])
            rows.append((r.row, r.doc_id, r.n, p.text, p.chars.tobytes(), p.counts.tobytes(), p.ids.tobytes()))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")])


def _gather(parts: pd.DataFrame, path: str) -> pd.DataFrame:
    tree = tree_encoder(path)
    tree.words.trim()
    read = lambda b, t: np.frombuffer(b, t)
    held = [Part(r.text, read(r.chars, np.int64), read(r.counts, np.int64), read(r.ids, np.uint32)) for r in parts.sort_values("n").itertuples()]
    return pd.DataFrame([(parts["doc_id"].iloc[0], *_said(tree.tree(held).ids, tree))], columns=NAMES)


def round_trip(docs: DataFrame, path: str, spread: int = SPREAD) -> DataFrame:
    """Per document the count and digest of its ids, and the digest of the text that they decode to."""
    rows = short_batches(docs).select(ids(), whole().alias("text"))
    special = encoder(path).special
    far = F.length("text") > spread
    for s in special:
        far = far & ~F.contains("text", F.lit(s))
    short = rows.where(~far).mapInPandas(lambda it: _short(it, path), DIGEST)
    # Every long text becomes its equal parts, in order; a row number keeps equal doc_ids apart.
    parts = F.ceil(F.length("text") / F.lit(spread)).cast("int")
    pieces = rows.where(far).withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.explode(F.sequence(F.lit(0), parts - 1)))
    pieces = pieces.select("row", "doc_id", "n", F.expr(f"substring(text, n * {spread} + 1, {spread})").alias("text"))
    encoded = pieces.repartition("row", "n").mapInPandas(lambda it: _spread(it, path), PART)
    return with_nulls(short.union(encoded.groupBy("row").applyInPandas(lambda p: _gather(p, path), DIGEST)), "doc_id")


def op9_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
