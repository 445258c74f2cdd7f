"""The pipeline on its own table: every stage does its work on what its predecessor kept."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from meterlake.llm import secrets
from meterlake.session import written
from .test_near_dedup import brute as near_brute


@pytest.fixture(scope="module")
def kept(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), f"test-{name}")
        out.append((name, docs))
    return out


def test_stages_and_columns(kept):
    assert [n for n, _ in kept[1:]] == ["language", "exact_dedup", "near_dedup", "secrets", "packing"]
    for _, df in kept[1:-1]:
        assert df.columns == kept[0][1].columns


def test_language_keeps_the_labelled(kept):
    before, after = kept[0][1], kept[1][1]
    clean = before.where("lang IS NOT NULL AND text IS NOT NULL").count()
    gone = before.join(after.select("doc_id"), "doc_id", "left_anti").where("lang IS NOT NULL AND text RLIKE '[a-z]{3}'").count()
    assert gone <= 0.02 * clean


def test_exact_copies_go(kept):
    norm = lambda t: hashlib.sha256(re.sub("[ \t-\r]+", " ", t or "").encode()).hexdigest()
    before, after = (sorted((norm(r["text"]), r["doc_id"]) for r in kept[k][1].collect()) for k in (1, 2))
    first = {}
    for h, i in before:
        first.setdefault(h, i)
    assert after == sorted(first.items())


def test_near_copies_go(kept):
    before = [(r["doc_id"], r["text"]) for r in kept[2][1].collect()]
    want = sorted(i for i, (n, c) in near_brute(before, 5).items() if i == c or not n)
    assert sorted(r["doc_id"] for r in kept[3][1].collect()) == want


def test_secrets_are_gone_and_the_rest_stays(kept):
    before = {r["doc_id"]: r for r in kept[3][1].collect()}
    after = {r["doc_id"]: r for r in kept[4][1].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r["text"] == (secrets.redacted(before[i]["text"]) if before[i]["text"] else before[i]["text"])
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_packing_holds_every_document(kept):
    ids = {r["doc_id"] for r in kept[4][1].collect()}
    pieces = kept[5][1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces} == ids and all(r["n"] == r["t"] for r in pieces)


def test_edge_cases_pass_through_all_stages(spark, documents, edge_rows, words, data):
    """Nulls in any column, empty and very long texts, repeated rows and ties, clashing columns."""
    rows = [(i, t, "aa") for i, t, *_ in edge_rows] + [(100 + i, words(40, 900 + i), "aa" if i % 2 else None) for i in range(80)] + [(300, words(40, 901), "aa"), (301, "12 34", "aa")]
    docs = documents(rows, clash=True).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.when(F.col("doc_id") != 1, F.col("n_chars")))
    columns, ids = docs.columns, {"documents": {r["doc_id"] for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), f"edge-{name}")
        got = docs.select("doc_id", *(["text"] if name != "packing" else ["length"])).collect()
        ids[name] = {r["doc_id"] for r in got}
        if name != "packing":
            assert docs.columns == columns
        if name in ("exact_dedup", "near_dedup", "secrets"):
            assert len(got) == len({(r["doc_id"], r["text"]) for r in got})
    # Without a letter, empty, or null: no language. Copies go, the first of them stays.
    assert {2, 3, 4, 301, None} & ids["language"] <= {None} and {1, 5, 6, 7} <= ids["language"]
    assert 5 not in ids["exact_dedup"] and 1 in ids["exact_dedup"] and 300 not in ids["exact_dedup"] and 101 in ids["exact_dedup"]
    assert ids["near_dedup"] == ids["secrets"] == ids["packing"] <= ids["exact_dedup"]


def test_empty_table_passes_through_all_stages(spark, documents, data):
    docs = documents([], clash=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), f"empty-{name}")
        assert docs.count() == 0 and (name == "packing" or docs.columns == columns)


def test_no_labels_keep_nothing(spark, documents, data):
    assert corpus_pipeline.known_language(spark, documents([(i, "some text", None) for i in range(9)]), data).count() == 0


def test_registered():
    assert len([n for n in __spark_entry__.queries() if n.startswith("op")]) == 13 and "pipeline" in __spark_entry__.queries()
