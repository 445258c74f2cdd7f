import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = (
    "digest row shard best low found spans base bands bits n id key part member items ids start length anchor context lo size data bucket "
    "accepted lang_pred score held_out vector list rep group gone_id stay_id stay_digest kept component keep_id seq class_id __found __digest"
).split()


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows, on request with columns of clashing names."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "aa", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(3)
        return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES)) if clash else df

    return make


@pytest.fixture(scope="session")
def words():
    """Reproducible prose: words(n, seed)."""

    def make(n, seed=0, stock=400):
        r = random.Random(seed)
        names = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(stock)]
        return " ".join(r.choice(names) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_rows(words):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, characters outside ASCII."""
    long = words(60_000, 5, 5000)
    return [
        (1, "plain text of some words"),
        (2, None),
        (3, ""),
        (4, " \t\n"),
        (5, "plain text of some words"),
        (5, "plain text of some words"),
        (6, long),
        (7, "ünïcode – \U0001f600 текст 漢字 <|endoftext|> é"),
        (8, "x" * 3000),
        (None, "a row without an id"),
        (None, None),
        (9, "\u0000control\u0001    spaces"),
    ]
