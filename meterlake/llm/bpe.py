"""Exact subword encoding of whole texts with the tokenizers library, one distinct word at a time.

Both vocabularies split a text into words first and merge inside words only, so the ids of a text are the ids of
its words in order. A worker keeps the ids of words it has met and lets the library's model merge each new word once;
when MOST_WORDS are held, those that were met once since the last time go, and the rarer half if they are still many.
The split is done here only for texts over an alphabet where Python's character classes and the library's agree; any
other text, or one that holds the string of a special token, goes to the library whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Words that a worker keeps (some 200 bytes each), code points of all of them, and of the longest that outlives a trim.
MOST_WORDS, MOST_CHARS, LONGEST = 1 << 18, 1 << 24, 64

#: ASCII without control characters, and the letters and marks of Latin-1 that are the same for both sides.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡«»¿À-ÖØ-öø-ÿ]*")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")


def _byte_symbols() -> dict[int, int]:
    """The printable code point that stands for each byte in a byte-level vocabulary."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


BYTE_SYMBOLS = _byte_symbols()


class _Index(dict):
    """Numbers words in order of first sight."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Ids of texts as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.lower = self.library.normalizer is not None
        self.pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.hits = np.zeros(1 << 16, np.uint32)
        self.used = self.chars = 0

    def trim(self) -> None:
        """Keeps the words that are met often, if the store is full. Numbers of words change."""
        n = len(self.index)
        if n <= MOST_WORDS and self.chars <= MOST_CHARS:
            return
        words = list(self.index)
        hits = self.hits[:n] * (np.fromiter(map(len, words), np.int64, n) <= LONGEST)
        keep = np.flatnonzero(hits > 1)
        if len(keep) > MOST_WORDS // 2:
            keep = np.sort(keep[np.argsort(hits[keep])[-(MOST_WORDS // 2) :]])
        lengths, flat = self.lengths[keep].astype(np.int64), self._flat(keep)
        self._clear()
        for i in keep.tolist():
            self.index[words[i]]
        self.index.new, self.chars = [], sum(len(words[i]) for i in keep.tolist())
        self._add(0, lengths, flat)

    def look_up(self, words: Iterable[str]) -> np.ndarray:
        """Numbers of the words, new ones among them."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64)
        self._learn()
        np.add.at(self.hits, at, 1)
        return at

    def _flat(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one after the other."""
        lengths = self.lengths[at].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def split(self, text: str) -> list[str] | None:
        """The words of a text; None if the library has to split it."""
        if PLAIN.fullmatch(text) is None:
            return None
        text = text.lower() if self.lower else text
        return None if any(s in text for s in self.special) else self.pattern.findall(text)

    def _learn(self) -> None:
        """Ids of the words that were new."""
        words, self.index.new = self.index.new, []
        if not words:
            return
        first = len(self.index) - len(words)
        self.chars += sum(map(len, words))
        got = [[t.id for t in self.merge(w.encode().decode("latin-1").translate(BYTE_SYMBOLS))] for w in words]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lengths.sum()))
        self._add(first, lengths, flat)

    def _add(self, first: int, lengths: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(lengths) > len(self.starts):
            self.starts, self.lengths, self.hits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths, self.hits))
        self.ids[self.used : self.used + len(flat)] = flat
        ends = np.cumsum(lengths)
        self.starts[first : first + len(lengths)] = self.used + ends - lengths
        self.lengths[first : first + len(lengths)] = lengths
        self.used += len(flat)

    def encode_ended(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with one more id at the end of each text."""
        flat, counts = self.encode(texts)
        out = np.empty(len(flat) + len(texts), np.uint32)
        last = np.cumsum(counts + 1) - 1
        own = np.ones(len(out), bool)
        own[last] = False
        out[last] = end_id
        out[own] = flat
        return out, counts + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        self.trim()
        split = list(map(self.split, texts))
        at = self.look_up(itertools.chain.from_iterable(w for w in split if w))
        flat, ends = self._flat(at), np.cumsum(self.lengths[at], dtype=np.int64)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *(len(w or ()) for w in split)])]
        counts = np.diff(bounds)
        if any(w is None for w in split):
            parts = [flat[bounds[i] : bounds[i + 1]] if w is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for i, (t, w) in enumerate(zip(texts, split, strict=True))]
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat.astype(np.uint32, copy=False), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker for a vocabulary."""
    return Encoder(path)
