"""Tree concatenation against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterlake.llm.bpe import Encoder
from meterlake.llm.tree_bpe import TreeEncoder, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def tree():
    return TreeEncoder(Encoder(PATH), leaf=16, unsplit=8)


PIECES = st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" the", "the", "  ", "\n\n", "'s", "'ll", "123", "aaaaaaaaaaaaaaaa", "=-=-=-", "é", " ", "\U0001f600", "<|endoftext|>", " '", "   x"])), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_small_leaves(tree, library, text):
    text = text.encode("utf-8", "replace").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    got = tree.encode(text)
    assert got.tolist() == ids
    assert tree.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_long_words(tree, library):
    r = random.Random(1)
    for stock in ("ab", "abcdefghij", "=", "the", "0123456789"):
        text = "".join(r.choice(stock) for _ in range(3000))
        assert tree.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("spread", [1 << 16, 500])
def test_round_trip(documents, edge_rows, words, library, spread):
    rows = [*edge_rows, *((100 + i, words(30 * i, i)) for i in range(20)), (300, "a" * 70_000), (301, " \n" * 40_000), (302, "don't " * 15_000)]
    got = sorted(map(repr, map(tuple, round_trip(documents(rows, clash=True), PATH, spread).collect())))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(map(repr, want))


def test_empty_table(documents):
    assert round_trip(documents([]), PATH).count() == 0


def test_a_full_store_of_words_keeps_what_is_met_often(words, monkeypatch):
    from meterlake.llm import bpe

    e = bpe.Encoder(PATH)
    texts = [words(60, k, 3000) + " " + " ".join(f"q{k}x{i}" for i in range(40)) for k in range(60)]
    want = [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "MOST_WORDS", 900)
    monkeypatch.setattr(bpe, "MOST_CHARS", 9000)
    seen = []
    for t, ids in zip(texts * 2, want * 2, strict=True):
        flat, counts = e.encode([t, "w" * 100, t])
        assert flat[: len(ids)].tolist() == ids == flat[len(flat) - len(ids) :].tolist() and counts[0] == len(ids)
        seen.append(len(e.index))
        assert len(e.index) <= 900 + 300 and len(e.index) == len(set(e.index.values()))
    assert any(b < a for a, b in zip(seen, seen[1:], strict=False)) and min(seen[5:]) > 50
