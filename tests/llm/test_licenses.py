"""License scan: base phrases against plain Python, rules against known notices."""

import random
import re
from re import _parser

import pytest

from meterlake.llm import licenses
from meterlake.llm.license_rules import RULES, TABLE

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


ROWS = [
    (30, "Apache License apache license, APACHE-LICENSE! mit license"),
    (31, "the mit licenses; xmit license; cc by, cc  by"),
    (32, "GNU General Public License " * 50),
    (33, "cc by cc by cc by"),
    (34, "ﬁne İstanbul MIT LICENSE ß"),
    (35, MIT),
]


@pytest.mark.parametrize("clash", [False, True])
def test_base(documents, edge_rows, clash):
    rows = [*edge_rows, *ROWS]
    got = sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in licenses.scan(documents(rows, clash)).collect())))
    assert got == sorted(map(repr, ((i, *base(t)) for i, t, *_ in rows)))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT, "mit"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache,apache-2.0"),
        ("released under the GNU General Public License, version 3 as such", "gpl,gpl-3.0"),
        ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("A license to kill, and a mitigation of apaches.", ""),
        ("The quick brown fox.", ""),
    ],
)
def test_labels(documents, text, labels):
    (row,) = licenses.scan(documents([(1, text)])).collect()
    assert row["labels"] == labels
    assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(labels)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("See https://www.apache.org/licenses/LICENSE-2.0 for it", "apache-2.0"),
        ("<https://creativecommons.org/licenses/by/4.0/>", "cc-by"),
        ("// https://creativecommons.org/licenses/by-nc-sa/4.0", "cc-by-nc-sa"),
        ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"),
        ("https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html", "lgpl"),
        ("https://www.boost.org/LICENSE_1_0.txt", "bsl-1.0"),
        ("https://mozilla.org/MPL/2.0/", "mpl-2.0"),
        ("University of Illinois/NCSA Open Source License", "ncsa"),
        ("the Tcl/Tk license, the zlib/libpng license", "zlib"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose\n * with or without fee is hereby granted", "isc"),
        ("DO WHAT THE F*** YOU WANT TO PUBLIC LICENSE", "wtfpl"),
        ("https://opensource.org/license/mit", "mit"),
    ],
)
def test_slashes(documents, text, label):
    (row,) = licenses.scan(documents([(1, text)])).collect()
    assert label in row["labels"].split(",") and row["score"] > 0


def sample(pattern, rng):
    """A text that a pattern matches, choices at random."""

    def one(nodes):
        out = ""
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = rng.choice(arg)
                out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
            elif name == "ANY":
                out += "x"
            elif name == "SUBPATTERN":
                out += one(arg[3])
            elif name == "BRANCH":
                out += one(rng.choice(arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(one(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            else:
                assert name in ("AT", "ASSERT_NOT"), name
        return out

    return one(_parser.parse(pattern))


def samples():
    rng = random.Random(3)
    return [(r, t) for r in RULES for t in {sample(r.pattern, rng) for _ in range(4)} if re.search(r.pattern, t)]


def test_every_rule_fires(documents):
    """A sample of each rule has its label, or that of a rule at least as strong that holds its interval."""
    some = samples()
    assert {r for r, _ in some} == set(RULES)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(documents([(i, t) for i, (_, t) in enumerate(some)])).collect()}
    stronger = lambda rule, text: {r.label for r in RULES if r.priority <= rule.priority and any(m[0] == text for m in re.finditer(r.pattern, text))}
    lost = [(r.pattern, t, got[i]) for i, (r, t) in enumerate(some) if r.label not in got[i] and not stronger(r, t) & set(got[i])]
    assert lost == []


LOST = ["Released under the MIT", "MIT-0", "0BSD", "Commons Clause", "proprietary and confidential", "MPL 2.0", "ASL 2.0", "same terms as Perl itself", "GNU Public License", "ODbL", "Expat License", "Internet Systems Consortium License", "open rail", "all rights\n * reserved", "placed into\n// the public\n// domain"]


def test_prefilter_drops_nothing(documents):
    texts = LOST + [t for _, t in samples()] + [t.replace(" ", "\n * ") for _, t in samples()]
    docs = documents([(i, f"See {t} here") for i, t in enumerate(texts)])
    got, want = (dict(licenses.scan(docs, x).select("doc_id", "labels").collect()) for x in (True, False))
    assert got == want and all(got[i] for i in range(len(LOST)))


def test_keywords_are_in_every_match():
    assert all(any(k in t for k in r.keywords) and re.search(licenses.STEMS, t) for r, t in samples())


def test_hundreds_of_rules():
    assert sum(1 + line.count(" ;; ") for line in TABLE.strip().splitlines()) >= 300
    assert len(RULES) == len({(r.label, r.pattern) for r in RULES})
    assert all(r.priority in licenses.WEIGHTS and re.compile(r.pattern) for r in RULES)


def test_contained_interval_of_a_weaker_rule_is_suppressed(documents):
    (row,) = licenses.scan(documents([(1, "GNU Library General Public License")])).collect()
    assert "lgpl" in row["labels"] and row["labels"].count("gpl") == row["labels"].count("lgpl")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        # A longer interval of equal priority holds the shorter one.
        ("GNU General Public License version 3", "gpl,gpl-3.0"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa"),
        ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
        # A stronger rule that only touches a weaker one leaves it.
        ("SPDX-License-Identifier: ISC; PHP license", "isc,php-3.01"),
        # A weaker rule that begins earlier, or ends later, is not contained.
        ("clear BSD license 3-clause BSD", "bsd-3-clause,bsd-3-clause-clear"),
        ("Apache License v2.0 with LLVM exceptions", "apache,apache-2.0-llvm"),
        # The same notice twice is one label; a second, free-standing weak one stays.
        ("MIT license. MIT license. All rights reserved", "mit,proprietary"),
        ("GNU Affero General Public License, version 3 or a GNU GPL", "agpl-3.0,gpl"),
    ],
)
def test_priority_and_containment(documents, text, labels):
    (row,) = licenses.scan(documents([(1, text)])).collect()
    assert row["labels"] == labels


def test_no_python_in_the_plan(spark, documents):
    plan = licenses.scan(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("repartition", "").split("Project")[0]


def test_empty_table(documents):
    assert licenses.scan(documents([])).count() == 0


def test_running_sums(spark):
    rows = [([],), ([5],), ([1, 2],), (list(range(1000)),), ([3] * 17,)]
    df = spark.createDataFrame(rows, "x array<int>")
    for x, got in df.select("x", licenses._running(df["x"])).collect():
        assert got == [sum(x[: i + 1]) for i in range(len(x))] if len(x) < 100 else got[-1] == sum(x) and got[500] == sum(x[:501])


def test_many_matches_in_a_long_text(documents):
    """A hundred thousand matches in one text take seconds, and give the labels of a few."""
    text = "gnu gpl license and the mit license. "
    few, many = sorted(licenses.scan(documents([(1, text * 3), (2, text * 100_000)])).collect())
    assert (few["labels"], few["score"]) == (many["labels"], many["score"]) and many["n_base"] == 100_000
