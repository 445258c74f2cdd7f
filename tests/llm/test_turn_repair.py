"""Repair of conversations against every sequence of edits, and against one piece where there are several."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from meterlake.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """The letter of each row as the search reads it, by the contract's words."""
    out, seen = [], set()
    for role, text in rows:
        own = role[:1] if role[:1] in ("s", "u", "a") else "x"
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else own if bare[-1] in ".!?" else own.upper())
        seen.add((role, text))
    return "".join(out)


def every_edit(codes):
    """(cost, audit) of the best of all sequences of edits."""
    best = None
    for n in range(len(codes) * 2 + 2):
        for audit in itertools.product("DIKR", repeat=n):
            if n - audit.count("I") != len(codes):
                continue
            cost, i, roles = 0, 0, []
            for letter in audit:
                if letter == "I":
                    cost += 2
                    roles.append("ua")
                    continue
                code, i = codes[i], i + 1
                if letter == "D":
                    cost += 3
                elif code in "bd":
                    cost = None
                    break
                else:
                    cost += code.isupper() + 2 * (letter == "R")
                    roles.append(code.lower() if letter == "K" else "ua")
            if cost is None or best and (cost, "".join(audit)) >= best:
                continue
            if any(GRAMMAR.fullmatch("".join(r)) for r in itertools.product(*roles)):
                best = (cost, "".join(audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cheapest_and_least_of_all_edits(n):
    every = list(itertools.product("suaxSUAbd", repeat=n))
    for codes in random.Random(n).sample(every, min(60, len(every))):
        assert next(iter(T.search("".join(codes)).values())) == every_edit("".join(codes)), codes


def test_chained_pieces_are_the_whole():
    r = random.Random(7)
    for _ in range(200):
        codes = "".join(r.choice("suauauauaxSUAbd") for _ in range(r.randint(1, 40)))
        cuts = sorted(r.sample(range(len(codes) + 1), min(len(codes), 4)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        steps = T.chain(parts)
        assert (sum(c for _, _, c in steps), "".join(a for _, a, _ in steps)) == next(iter(T.search(codes).values()))


def expected(rows):
    """The report of each conversation of (conv_id, turn, role, text), damage included, row by row."""
    out = {}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by_conv[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        codes = faults([t[1:] for t in turns])
        cost, audit = next(iter(T.search(codes).values()))
        numbers = {t[0] for t in turns if t[0] is not None}
        initials = [t[1][:1] for t in turns]
        kept = T.edited(codes, [t[1] for t in turns], [t[2] for t in turns], 0, audit)
        lines = "\n".join(f"{r}:{t}" for r, t in zip(*kept, strict=True))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, codes.count("b"), codes.count("d"), sum(map(str.isupper, codes)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(lines.encode()).hexdigest(),
        )
    return out


def reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in T.report(T.repair(T.damaged(df))).collect()}


def talk(seed, conv, n):
    r = random.Random(seed)
    return [(conv, t, r.choice(("user", "assistant", "user", "assistant", "system", "tool")), r.choice(("Yes.", "No!", "so it is", "Why?", "", " \n", f"text {r.random()}."))) for t in range(n)]


@pytest.mark.parametrize("limit", [256, 4])
def test_reports_against_row_by_row(spark, monkeypatch, limit):
    """Long conversations among short ones, in pieces of any size, give the same reports."""
    monkeypatch.setattr(T, "PIECE_ROWS", limit)
    rows = [x for c in range(40) for x in talk(c, c, c % 9)] + talk(99, 1000, 700) + talk(5, 1001, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert reported(df) == expected(rows)


def test_edge_cases(spark):
    long = "word " * 300_000
    rows = [
        (1, None, "user", "a question?"), (1, None, "user", "a question?"), (1, 2, None, None), (1, 5, "assistant", long), (2, 1, "", "x."), (2, 1, "tool", "x."), (2, 9, "user", " \t\n"),
        (None, 0, "user", "hello."), (None, 1, "assistant", "hello."), (3, None, None, None), (4, 1, "system", "be kind."), (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "user", "same."),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", part string, code string").repartition(3)
    assert reported(df) == expected(rows)


def test_a_conversation_without_rows_has_a_report_of_zeros(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = reported(spark.createDataFrame([(gone, 0, "user", "text.")], SCHEMA))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_follow_the_grammar(spark):
    rows = [x for c in range(20) for x in talk(c + 50, c, 12)]
    turns = T.repaired_turns(T.repair(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "part", "seq", "place").collect()
    by_conv = {}
    for r in turns:
        by_conv[r["conv_id"]] = by_conv.get(r["conv_id"], "") + r["role"][0]
    assert len(by_conv) > 10 and all(GRAMMAR.fullmatch(x) for x in by_conv.values())


def test_ids_of_any_type_and_an_empty_table(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    assert T.report(T.repair(df)).collect()[0]["audit"] == "KK"
    assert T.report(T.repair(df.limit(0))).count() == 0
