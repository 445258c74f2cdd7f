"""Language identification: held-out accuracy, rejection, and the edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import language
from meterlake.llm.language import op5_language

ALPHABETS = {"aa": "abcdeilnorst", "bb": "fghjkmpquvwxyz", "cc": "абвгдежзикл"}


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(0)
    stock = {k: ["".join(rng.choice(list(a), rng.integers(3, 8))) for _ in range(150)] for k, a in ALPHABETS.items()}
    return lambda lang, n: " ".join(rng.choice(stock[lang], n))


@pytest.fixture(scope="module")
def model(documents, prose):
    langs = list(ALPHABETS)
    docs = documents([(i, prose(langs[i % 3], 30), langs[i % 3]) for i in range(400)])
    return docs, language.train(docs)


def test_held_out_accuracy_on_the_data(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = op5_language(spark, data).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n and right / n >= 0.9


def test_fold_is_stated(documents):
    import zlib

    got = {r["doc_id"]: r["f"] for r in documents([(i, "x") for i in range(50)]).select("doc_id", language.fold().alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 4 for i, f in got.items())


def test_predictions(documents, model, prose):
    _, m = model
    rows = [(i, prose(k, 40)) for i, k in enumerate(ALPHABETS)]
    got = sorted(language.predict(documents(rows), m).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got] == list(ALPHABETS)
    assert all(r["accepted"] and 0 <= r["score"] <= 1 for r in got)


def test_rejects_what_it_never_saw(documents, model):
    _, m = model
    got = language.predict(documents([(1, "漢字仮名交文日本語" * 20), (2, "12 34 !!"), (3, None), (4, "")]), m).collect()
    assert not any(r["accepted"] for r in got)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] > 1} == {2: "und", 3: "und", 4: "und"}


def test_hardly_any_clean_text_is_rejected(model):
    docs, m = model
    assert language.predict(docs, m).where("NOT accepted").count() <= 2


def test_a_language_that_is_held_out_is_rejected(documents):
    """Four languages over the same letters; one of them is never learned."""
    rng = np.random.default_rng(5)
    syllables = ["".join(rng.choice(list("bcdfglmnprstv"), 1)) + "".join(rng.choice(list("aeiou"), 1)) + "".join(rng.choice(list("lnrst"), 1)) for _ in range(160)]
    prose = lambda k, n: " ".join("".join(rng.choice(syllables[40 * k : 40 * k + 40], rng.integers(1, 4))) for _ in range(n))
    m = language.train(documents([(i, prose(i % 3, 60), f"l{i % 3}") for i in range(1200)]))
    seen, unseen = documents([(i, prose(i % 3, 60)) for i in range(200)]), documents([(i, prose(3, 60)) for i in range(200)])
    assert language.keep_known(seen, m).count() >= 198
    assert language.keep_known(unseen, m).count() <= 10


def test_sample_is_bounded_and_spans_whole_texts(documents):
    rows = [(i, "head " * 700 + "tail " * 700, f"l{i % 5}") for i in range(600)]
    got = language.sample(documents(rows), most_rows=40, most_all=100, most_languages=3)
    assert got["lang"].nunique() == 3
    assert len(got) <= 2 * 100 and got.groupby(["lang", "held"]).size().max() <= 40
    assert all(len(t) < 2100 and "head" in t and "tail" in t for t in got["text"])


def test_nothing_is_kept_where_nothing_was_learned(documents):
    docs = documents([(1, "abc", None)])
    assert language.keep_known(docs, language.train(docs)).count() == 0


def test_keep_known_leaves_columns_alone(documents, model, edge_rows):
    _, m = model
    df = documents(edge_rows, clash=True)
    kept = language.keep_known(df, m)
    assert kept.columns == df.columns
    assert all(r["accepted"] == "x" and r["__found"] == "x" for r in kept.collect())


def test_no_labels_one_label_no_rows(documents):
    none = language.train(documents([(1, "abc", None), (2, None, "aa")]))
    assert [r["lang_pred"] for r in language.predict(documents([(1, "abc")]), none).collect()] == ["und"]
    one = language.train(documents([(i, "some text here", "aa") for i in range(20)]))
    assert [r["lang_pred"] for r in language.predict(documents([(1, "abc")]), one).collect()] == ["aa"]
    assert language.predict(documents([]), language.train(documents([]))).count() == 0
