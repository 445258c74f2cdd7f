"""Conversations whose turns are brought into the order (system? (user assistant)+)? by the cheapest edits.

Dijkstra's search on the implicit lattice of (turn index, grammar state): Keep costs nothing, Rerole 2, Delete 3 (the only
edit of a blank or repeated row), Insert 2, and a truncated row that stays 1. The priority is (cost, audit), the audit being
the initials of the edits so far; the first accepting end node that is popped has the cheapest edits, of equal ones the
ASCII-least. Of two paths to one node with one cost neither audit begins with the other, so the order of audits holds when
paths are continued, and best paths of pieces are pieces of best paths.

Rows are dealt by ranges of (conversation, turn, role, text) and stream through their task in that order. What lies in one
piece of at most PIECE_ROWS rows, and does not touch the ends of its task, is a whole conversation and is repaired on the
spot. A longer one is several pieces: each is searched from every grammar state to every one, and the pieces' results
are chained. So a conversation of any length is many tasks; one task sees a line for each piece of a conversation, whose
audits are what the result holds in one row anyway. SHA-256 reads a conversation from its start, so its repaired pieces
pass through one task, one after the other.

Edge cases: nulls in conv_id, role and text count as one space in texts and keys; rows without turn come first; rows of one
turn are in the order of role and text; a role that is none of the three is no legal one, and a role is known by its first
letter; repeated rows are duplicates; a conversation that has no rows has a report of zeros; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meterlake.llm.common import short_batches, table
from meterlake.session import written

#: Rows, and characters, from which on a piece is full.
PIECE_ROWS, PIECE_CHARS = 256, 1 << 20
#: States: nothing yet, after system, after user, after assistant. What each may be followed by, and where one may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT = 2, 3, 2

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = "part int, seq int, closed boolean, codes string, roles array<string>, texts array<string>, keys array<binary>, low long, high long, gaps long, illegal long, head string, tail string"
_DONE = "part int, seq int, closed boolean, roles array<string>, texts array<string>, audit string, " + ", ".join(f"{c} long" for c in COUNTS)


def search(codes: str, start: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) by end state: of a whole conversation the one that is popped first, of a piece all.

    codes: a letter for each row: the role's initial (x for an illegal one), in capitals if truncated; b blank, d duplicate.
    """
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and (q in ENDS or not whole):
            found[q] = (cost, audit)
            if whole:
                break
        allowed = NEXT[q]
        moves = [(INSERT, "I", i, allowed[r]) for r in ROLES if r in allowed]
        if i < len(codes):
            code = codes[i]
            moves.append((DELETE, "D", i + 1, q))
            if code not in "bd":
                own, late = code.lower(), int(code.isupper())
                if own in allowed:
                    moves.append((late, "K", i + 1, allowed[own]))
                moves += [(REROLE + late, "R", i + 1, allowed[r]) for r in ROLES if r in allowed and r != own]
        for price, letter, j, p in moves:
            if (j, p) not in done:
                heapq.heappush(heap, (cost + price, audit + letter, j, p))
    return found


#: Conversations of the same faults are searched once by a worker.
_known = lru_cache(1 << 14)(search)


def chain(pieces: list[str]) -> list[tuple[int, str, int]]:
    """Start state, audit and cost of each piece on the cheapest way through all."""
    best, back = {0: (0, "")}, []
    for codes in pieces:
        after: dict[int, tuple] = {}
        for start, (cost, audit) in best.items():
            for end, (more, letters) in _known(codes, start, False).items():
                reached = (cost + more, audit + letters, start, letters, more)
                if end not in after or reached[:2] < after[end][:2]:
                    after[end] = reached
        back.append({end: x[2:] for end, x in after.items()})
        best = {end: x[:2] for end, x in after.items()}
    state, out = min((q for q in ENDS if q in best), key=best.get), []
    for step in reversed(back):
        start, letters, cost = step[state]
        out.append((start, letters, cost))
        state = start
    return out[::-1]


def edited(codes: str, roles: list[str], texts: list[str], start: int, audit: str) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit; the state says which role an inserted or changed row has."""
    state, i, out = start, 0, ([], [])
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            initial, role = codes[i].lower(), roles[i]
        else:
            initial = next(r for r in ROLES if r in NEXT[state])
            role = ROLES[initial]
        out[0].append(role)
        out[1].append("" if letter == "I" else texts[i])
        i += letter != "I"
        state = NEXT[state][initial]
    return out


class _Piece:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, part: int, seq: int, conv: object, whole: bool) -> None:
        self.part, self.seq, self.conv, self.whole = part, seq, conv, whole
        self.codes, self.roles, self.texts, self.seen, self.turns, self.chars = [], [], [], set(), [], 0

    def add(self, turn: int | None, role: str, text: str, code: str) -> None:
        key = (role, text)
        self.codes.append("d" if code != "b" and key in self.seen else code)
        self.seen.add(key)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.codes) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def row(self, ended: bool) -> dict:
        closed, turns = self.whole and ended, self.turns
        initials = [r[:1] for r in self.roles]
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
        return {
            "conv_id": self.conv, "part": self.part, "seq": self.seq, "closed": closed, "codes": "".join(self.codes), "roles": self.roles, "texts": self.texts,
            "keys": None if closed else [digest(r, t) for r, t in zip(self.roles, self.texts, strict=True)],
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
        }


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows. The first and the last conversation of a task may go on in its neighbours."""
    held, seq = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is None or row["conv_id"] != held.conv:
                if held:
                    out.append(held.row(ended=True))
                held, seq = _Piece(row["part"], seq + 1, row["conv_id"], whole=seq > 0), seq + 1
            for _ in range(row["copies"]):
                if held.full():
                    held.whole = False
                    out.append(held.row(ended=False))
                    held, seq = _Piece(row["part"], seq + 1, row["conv_id"], whole=False), seq + 1
                held.add(row["turn"], row["role"], row["text"], row["code"])
        yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist([held.row(ended=False)], schema)


def code(role: Column, text: Column) -> Column:
    """The letter of a row, but for duplicates: role, truncation, blankness."""
    trimmed = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring(role, 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(trimmed == "", F.lit("b")).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), own).otherwise(F.upper(own))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces(rows: DataFrame) -> DataFrame:
    """Written pieces of conversations. rows: conv_id, turn, role, text, copies (how often a row stands there; 0 keeps the
    conversation alone)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {_PIECE}"
    schema = _arrow(ddl)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("int").alias("copies"))
    # The digest and the place part rows that are alike in all else.
    keyed = given.withColumns({"code": code(F.col("role"), F.col("text")), "beginning": F.substring("text", 1, 64), "digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "beginning", "digest", "place"]
    dealt = short_batches(keyed).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.select("conv_id", "turn", "role", "text", "copies", "code", F.spark_partition_id().alias("part"))
    return written(placed.mapInArrow(lambda it: _cut(it, schema), ddl), "pieces")


def _met_before(parts: DataFrame) -> DataFrame:
    """part, seq, late: the places in a piece whose role and text stand in an earlier piece of the conversation."""
    met = parts.select("conv_id", "part", "seq", F.posexplode("keys").alias("i", "key"))
    # Repetitions within a piece are known already: its first place speaks for it.
    met = met.groupBy("conv_id", "key", "part", "seq").agg(F.min("i").alias("i"))
    first = met.groupBy("conv_id", "key").agg(F.min(F.struct("part", "seq")).alias("at")).select("key", "at.part", "at.seq")
    return met.join(first, ["part", "seq", "key"], "left_anti").groupBy("part", "seq").agg(F.collect_list("i").alias("late"))


def _chained(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The decisions for the pieces of one conversation, and what happens where they meet."""
    group = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    for r in group:
        letters = list(r["codes"])
        for i in r["late"] or ():
            if letters[i] != "b":
                letters[i] = "d"
        r["codes"] = "".join(letters)
    rows, tail, high = [], None, None
    for r, (start, audit, cost) in zip(group, chain([r["codes"] for r in group]), strict=True):
        gaps, illegal = r["gaps"], r["illegal"]
        if r["low"] is not None:
            gaps += max(0, r["low"] - high - 1) if high is not None else 0
            high = r["high"]
        if r["head"] is not None:
            illegal += tail is not None and tail + r["head"] not in LEGAL
            tail = r["tail"]
        rows.append({"part": r["part"], "seq": r["seq"], "codes": r["codes"], "start": start, "audit": audit, "cost": cost, "gaps": gaps, "illegal": illegal})
    return pa.Table.from_pylist(rows, schema)


def _finish(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes = r["codes"]
            if r["audit"] is None:
                r["start"] = 0
                r["cost"], r["audit"] = next(iter(_known(codes).values()))
            kept = edited(codes, r["roles"], r["texts"], r["start"], r["audit"])
            faults = {"blank": codes.count("b"), "duplicate": codes.count("d"), "truncated": sum(map(str.isupper, codes))}
            out.append({k: r[k] for k in ("conv_id", "part", "seq", "closed", "audit", "cost", "gaps", "illegal")} | faults | {"roles": kept[0], "texts": kept[1]})
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired pieces of conversations: conv_id, part and seq (their order), closed (it is the whole conversation), roles and
    texts as arrays, audit, and what adds up over the pieces: gaps, blank, duplicate, truncated, illegal, cost.

    rows: conv_id, turn, role, text, and copies, 1 where it is not given.
    """
    cut = pieces(rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1)))
    ddl = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, {_DONE}"
    schema = _arrow(ddl)
    plain = ["conv_id", "part", "seq", "closed", "roles", "texts"]
    whole = cut.where("closed").select(*plain, "codes", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("cost"), "gaps", "illegal")
    several = cut.where("NOT closed")
    narrow = several.select("conv_id", "part", "seq", "codes", "low", "high", "gaps", "illegal", "head", "tail").join(_met_before(several), ["part", "seq"], "left")
    ways = "part int, seq int, codes string, start int, audit string, cost long, gaps long, illegal long"
    way = _arrow(ways)
    decided = written(narrow.groupBy("conv_id").applyInArrow(lambda t: _chained(t, way), ways), "decided")
    names = ["codes", "start", "audit", "cost", "gaps", "illegal"]
    both = whole.select(*plain, *names).union(several.select(*plain).join(decided, ["part", "seq"]).select(*plain, *names))
    return short_batches(both).mapInArrow(lambda it: _finish(it, schema), ddl)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text: one row for each turn of repair(), in that order within a conversation."""
    return repaired.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select("conv_id", "part", "seq", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted pieces, which pass one by one."""
    own, digest, audits, sums, begun = None, None, [], None, False

    def row() -> dict:
        return {"conv_id": own, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()} | sums

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if digest is None or r["conv_id"] != own:
                if digest:
                    out.append(row())
                own, digest, audits, sums, begun = r["conv_id"], hashlib.sha256(), [], dict.fromkeys(COUNTS, 0), False
            if r["turns"]:
                digest.update(("\n" * begun + r["lines"]).encode())
                begun = True
            audits.append(r["audit"])
            for c in COUNTS:
                sums[c] += r[c]
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest:
        yield pa.RecordBatch.from_pylist([row()], schema)


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of repair(): counts of faults, cost, audit, and a digest of the repaired turns."""
    line = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    rows = repaired.select("conv_id", "part", "seq", "closed", "audit", *COUNTS, F.size("roles").alias("turns"), F.array_join(line, "\n").alias("lines"))
    rows = written(rows, "repaired")
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    closed = rows.where("closed").withColumn("repaired_sha256", F.sha2(F.col("lines").cast("binary"), 256)).select(*names)
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    schema = _arrow(ddl)
    rest = rows.where("NOT closed").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return closed.union(short_batches(rest).mapInArrow(lambda it: _hashed(it, schema), ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows that are dropped, emptied, stripped of marks, doubled or given to the user, by
    crc32 of `conv_id:turn` modulo 20."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = name("role"), name("text")
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repair(damaged(table(spark, sf_dir, "conversations"))))
