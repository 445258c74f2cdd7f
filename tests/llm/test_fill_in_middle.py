"""Cuts of texts against regular expressions of whole units, examples against a plain version, round trips."""

import hashlib
import re

import pytest

from meterlake.llm import fill_in_middle as M

S = "\x20\x09-\x0d"
UNITS = {
    "token": rf"[{S}]*[^{S}]+|[{S}]+",
    "word": r"\w+|\W+",
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": rf"(?:[^.!?]|[.!?](?![{S}]))*[.!?](?=[{S}])|(?:[^.!?]|[.!?](?![{S}]))+",
    "character": r"(?s:.)",
}
TEXTS = ["", " ", "one", " lead and trail \n", "a\n\nb\n", "It is. So! Is it?  Yes", "x😀y z w é", "\x0b\x0c tabs\tand\x1cmore", "..!? a", "word " * 30_000]


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_boundaries_give_the_units_of_the_grammar(spark, unit):
    texts = [t for t in TEXTS if unit != "word" or t.isascii()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, got in df.select("text", M.units(df["text"], unit)).collect():
        assert got == [x for x in re.findall(UNITS[unit], text) if x]
        assert "".join(got) == text


def plain(doc_id, text, seed=42):
    text = text or ""
    pieces = re.findall(UNITS["token"], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(pieces) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(pieces), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(pieces), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(pieces), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_examples_and_round_trip(spark, documents, edge_rows, words):
    rows = edge_rows + [(i, t) for i, t in enumerate(TEXTS, 100)] + [(200 + i, words(40, i)) for i in range(60)] + [(300, "holds <P> already"), (301, "<M>"), (302, "< P> <Q <S <M")]
    for clash in (False, True):
        docs = documents(rows, clash)
        out = M.restored(M.transform(docs))
        assert out.columns[: len(docs.columns)] == docs.columns
        got = sorted(map(repr, (tuple(r) for r in out.selectExpr("doc_id", "text", "fim_n", "fim_form", "length(fim_prefix)", "length(fim_middle)", "fim_output").collect())))
        assert got == sorted(repr((i, t, *plain(i, t))) for i, t, *_ in rows)
        assert out.where("fim_restored <> coalesce(text, '')").count() == 0
    assert {plain(i, t)[1] for i, t, *_ in rows} == {"plain", "spm", "psm"}


def test_rules_are_parameters(spark, documents, words):
    docs = documents([(i, words(30, i)) for i in range(80)])
    every = M.transform(docs, M.Rule(unit="character", seed=7, changed=100, suffix_first=0))
    assert {r[0] for r in every.select("fim_form").distinct().collect()} == {"psm"}
    assert every.where("length(text) <> fim_n").count() == 0
    assert M.transform(docs, M.Rule(changed=0)).where("fim_output <> text").count() == 0


def test_no_python_and_no_exchange_in_the_plan(spark, data):
    plan = M.op12_fill_in_middle(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "InPandas" not in plan


def test_empty_table(documents):
    assert M.restored(M.transform(documents([]))).count() == 0
