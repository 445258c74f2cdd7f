"""Packing: every id in one piece, no gaps, little padding; the subset sums against all subsets."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 90))
def test_least_slack_is_the_best_subset(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    best = max(s for k in range(len(lengths) + 1) for x in itertools.combinations(lengths, k) if (s := sum(x)) <= capacity)
    chosen = packing.least_slack(counts, capacity)
    assert sum(n * k for n, k in chosen.items()) == best
    assert all(k <= counts[n] for n, k in chosen.items())


@pytest.mark.parametrize("window", [64, 1024])
def test_pieces(documents, edge_rows, words, window):
    rows = [*edge_rows, *((100 + i, words((i * 37) % 300, i)) for i in range(150))]
    got = packing.pack(documents(rows, clash=True), PATH, window=window).collect()
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, texts in want.items():
        flat = sorted(x for _, ids, _ in pieces[i] for x in ids)
        assert flat == sorted(x for t in texts for x in t)
        if len(texts) == 1:
            at = 0
            for start, ids, total in sorted(pieces[i]):
                assert start == at and total == len(texts[0]) and ids == texts[0][at : at + len(ids)]
                at += len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(len(t) for x in want.values() for t in x)
    assert len(sequences) * window <= total + 3 * window


def test_digests(documents):
    (row,) = packing.pack(documents([(4, None)]), PATH, with_ids=False).collect()
    assert (row["doc_id"], row["start"], row["length"], row["doc_tokens"], row["offset"]) == (4, 0, 1, 1, 0)
    assert row["ids_crc32"] == zlib.crc32(bytes(4))


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).count() == 0
