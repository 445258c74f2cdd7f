"""Token-id shards: the matrix against plain lists, the files against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterlake.llm import wavelet
from meterlake.session import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 99), max_size=400), st.integers(0, 99))
def test_matrix(ids, token):
    m = wavelet.WaveletMatrix.build(np.array(ids, np.uint32), 7)
    assert m.decode().tolist() == ids
    assert [m.access(i) for i in range(len(ids))] == ids
    places = [i for i, x in enumerate(ids) if x == token]
    assert m.count(token) == len(places)
    assert [m.find(token, j) for j in range(len(places) + 1)] == [*places, -1]
    half = len(ids) // 2
    assert m.count(token, half // 2, half) == ids[half // 2 : half].count(token)


def test_matrix_beyond_a_sample():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * wavelet.SAMPLE + 17).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.decode() == ids).all()
    for i in (0, wavelet.SAMPLE - 1, wavelet.SAMPLE, len(ids) - 1):
        assert m.access(i) == ids[i] and m.find(int(ids[i]), m.count(int(ids[i]), 0, i)) == i


@pytest.mark.parametrize("shard_tokens", [64, 1 << 20])
def test_files(spark, documents, edge_rows, words, shard_tokens):
    rows = [*edge_rows, *((100 + i, words(i % 40, i)) for i in range(60))]
    folder = shared_folder(spark, "op3-test")
    wavelet.write_shards(documents(rows, clash=True), folder, PATH, shard_tokens=shard_tokens)
    got = sorted(wavelet.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for r, (i, text, *_) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("shard_tokens", [64, 1 << 20])
def test_answers_from_the_files(spark, documents, edge_rows, words, shard_tokens, monkeypatch):
    """Access, counts and occurrences by rank and select over what is on disk, no shard decoded."""
    rows = [*edge_rows, *((100 + i, words(i % 40, i)) for i in range(30))]
    folder = shared_folder(spark, "op3-answers")
    wavelet.write_shards(documents(rows), folder, PATH, shard_tokens=shard_tokens)
    library = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    ids = [x for _, text, *_ in order for x in (*library.encode(text or "", add_special_tokens=False).ids, 2)]
    monkeypatch.setattr(wavelet.WaveletMatrix, "decode", None)
    places = [0, 1, 63, 64, 65, len(ids) // 2, len(ids) - 1, len(ids), -1, 5, 5]
    got = wavelet.access(spark, folder, spark.createDataFrame([(p, "x", "y") for p in places], "place long, part string, seq string"), shard_tokens)
    assert sorted(map(tuple, got.collect())) == sorted((p, ids[p]) for p in places if 0 <= p < len(ids))
    rare = next(x for x in ids if x != 2)
    tokens = [2, rare, 49_000]
    assert dict(map(tuple, wavelet.count(spark, folder, tokens).collect())) == {t: ids.count(t) for t in tokens}
    assert sorted(map(tuple, wavelet.occurrences(spark, folder, [2, rare]).collect())) == sorted((t, i) for t in {2, rare} for i, x in enumerate(ids) if x == t)
    ends = [i for i, x in enumerate(ids) if x == 2]
    for j in (0, 1, len(ends) // 2, len(ends) - 1):
        assert wavelet.find(spark, folder, 2, j) == ends[j]
    assert wavelet.find(spark, folder, 2, len(ends)) is None


def test_empty_table(spark, documents):
    folder = shared_folder(spark, "op3-empty")
    wavelet.write_shards(documents([]), folder, PATH)
    assert wavelet.read_documents(spark, folder).count() == 0
