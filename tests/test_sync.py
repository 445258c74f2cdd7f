"""Logs that grow, fail, move and are rewritten: the store after any number of runs is that of one read."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions.config import Config
from meterlake.operators import normalize
from meterlake.sources import READERS, STEPS
from meterlake.sources.lines import finished_lines
from meterlake.streaming import sync as S
from meterlake.streaming.commits import Change, Store

AT = "2026-01-01T00:00:{:06.3f}Z"


def codex_log(r, n, fork):
    meta = {"type": "session_meta", "timestamp": AT.format(0), "payload": {"id": "m", "model_provider": "openai", "cwd": "/w", "model": "gpt-5"} | ({"source": "subagent"} if fork else {})}
    rows, total, at = [meta], 0, 0.0
    for _ in range(n):
        at += r.choice((0.3, 0.3, 0.9, 0.9, 1.2))
        kind = r.randrange(8)
        total += r.choice((0, 7, 7, -3))
        vector = {"input_tokens": r.choice((5, 9)), "outputTokens": 3, "total_tokens": r.choice((12, 20))}
        if kind < 3:
            rows.append({"timestamp": AT.format(at), "event_msg": {"payload": {"type": "token_count", "info": {"last_token_usage": vector}}}} if kind else {"type": "event_msg", "timestamp": AT.format(at), "payload": {"type": "token_count", "info": {"last_token_usage": vector}}})
        elif kind < 5:
            rows.append({"type": "token_count", "timestamp": AT.format(at), "payload": {"total_token_usage": {"input_tokens": total, "total_tokens": total}}})
        elif kind == 5:
            rows.append({"turn_context": {"model": r.choice(("gpt-5", "gpt-6")), "turn_id": f"t{r.randrange(9)}"}})
        else:
            rows.append({"type": "session_meta", "payload": {"model": "late", "cwd": "/late"}} if kind == 6 else ["no object"])
    return rows


def claude_log(r, n):
    rows = [{"type": "user", "uuid": "u0", "cwd": "/w", "message": {"role": "user"}}]
    for i in range(1, n):
        parent = f"u{r.randrange(max(1, i - 3), i + 2) - 1}"
        if r.random() < 0.4:
            rows.append({"type": "user", "uuid": f"u{i}", "parentUuid": parent, "message": {"role": "user"}} | ({"cwd": f"/w{i}"} if r.random() < 0.3 else {}))
        else:
            usage = {"input_tokens": r.choice((1, 2)), "output_tokens": r.choice((1, 1, -1))}
            rows.append({"type": "assistant", "uuid": f"u{i}", "parentUuid": parent, "requestId": "q", "timestamp": AT.format(i % 60), "message": {"id": f"m{r.randrange(4)}", "model": "claude-x", "usage": usage}})
    return rows


def pi_log(r, n):
    rows = [{"type": "header", "id": "h", "cwd": "/w"}]
    for i in range(1, n):
        role = r.choice(("user", "assistant"))
        rows.append({"type": "message", "id": f"n{i}", "parentId": f"n{r.randrange(max(0, i - 3), i + 2)}", "role": role, "timestamp": AT.format(i % 60)} | ({"usage": {"input": i, "output": 2}} if role == "assistant" else {}))
    return rows + [{"type": "header", "id": "other", "cwd": "/v"}, {"usage": {"output": 4}}]


LOGS = {"codex": lambda r, n: codex_log(r, n, r.random() < 0.7), "claude-code": claude_log, "pi": pi_log}


def plain(records):
    return sorted(repr(tuple(r)) for r in records.collect())


@pytest.mark.parametrize("harness", sorted(LOGS))
def test_steps_over_random_cuts_give_the_records_of_one_read(spark, harness):
    """Each file is cut at places of its own; the context of what came before stands in for it."""
    r, steps = random.Random(harness), STEPS[harness]
    logs = {f"/l/{name}.jsonl": LOGS[harness](r, 40) for name in "abcdef"}
    rows = [(f, i + 1, json.dumps(x)) for f, log in logs.items() for i, x in enumerate(log)]
    lines = spark.createDataFrame(rows, "file string, ordinal long, text string")
    cuts = {f: [0, *sorted(r.sample(range(1, len(log)), 2)), len(log)] for f, log in logs.items()}
    held, got = None, []
    for k in range(3):
        span = spark.createDataFrame([(f, c[k], c[k + 1]) for f, c in cuts.items()], "file string, low long, high long")
        fresh = steps.parsed(lines.join(span, "file").where("ordinal > low AND ordinal <= high").drop("low", "high"))
        both = fresh if held is None else held.unionByName(fresh)
        got += plain(steps.records(both).join(span, "file").where("ordinal > low").drop("low", "high"))
        context = steps.context(both)
        held = spark.createDataFrame(context.collect(), context.schema)
    assert sorted(got) == plain(READERS[harness](lines))
    assert held.count() < len(rows) * (0.4 if harness == "codex" else 1.1)


def dump(rows):
    return "".join(json.dumps(x) + "\n" for x in rows).encode()


def stored(st):
    return sorted(repr(tuple(r)) for r in st.read("bronze").select("kind", "reason", "logical_session_id", "request_id", "line_ordinal", "turn_id", "cwd", "fresh_input_tokens", "output_tokens").collect())


def once(spark, harness, folder):
    rows = normalize.raw(READERS[harness](finished_lines(spark, str(folder))), harness, "s")
    return sorted(repr(tuple(r)) for r in rows.select("kind", "reason", "logical_session_id", "request_id", "line_ordinal", "turn_id", "cwd", "fresh_input_tokens", "output_tokens").collect())


def test_a_growing_log_is_stored_once(spark, tmp_path, monkeypatch):
    """Open lines wait, what did not change is not read, ranges of any size give the same, a crash before the switch changes nothing."""
    logs, st = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 4)
    logs.mkdir()
    source, r = S.Source("s", "codex", f"file://{logs}"), random.Random(3)
    data = {n: dump(codex_log(r, 30, n == "a")) for n in "ab"}
    for step, share in enumerate((0.3, 0.7, 1.0)):
        for n, x in data.items():
            (logs / f"{n}.jsonl").write_bytes(x[: int(len(x) * share)])
            os.utime(logs / f"{n}.jsonl", (1000 + step, 1000 + step))
        if step == 1:
            before = (st.commits(), stored(st))
            with monkeypatch.context() as m:
                m.setattr(Change, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("crash")))
                with pytest.raises(RuntimeError, match="crash"):
                    S.sync_source(st, source, Config(), 700)
            assert (st.commits(), stored(st)) == before
        assert S.sync(st, [source], range_bytes=700)["errors"] == []
        assert stored(st) == once(spark, "codex", logs)
    with monkeypatch.context() as m:
        m.setattr(S, "new_lines", lambda *a: pytest.fail("a log was read"))
        assert S.sync(st, [source])["files"] == 0
    facts = st.read("facts")
    assert facts.count() == facts.select("harness", "logical_session_id", "request_id").distinct().count() == sum("'usage'" in x for x in stored(st))


def test_what_cannot_be_read_is_read_again(spark, tmp_path, monkeypatch):
    logs, st = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 4)
    logs.mkdir()
    source, r = S.Source("s", "pi", f"file://{logs}"), random.Random(5)
    for n in "ab":
        (logs / f"{n}.jsonl").write_bytes(dump([{"type": "session", "id": n}, *pi_log(r, 20)]))

    def listed(spark, source, real=S.listed):
        found = real(spark, source)
        found = spark.createDataFrame(found.collect(), found.schema)
        (logs / "b.jsonl").rename(tmp_path / "away")
        return found

    with monkeypatch.context() as m:
        m.setattr(S, "listed", listed)
        (error,) = S.sync(st, [S.Source("none", "nothing", "x"), source])["errors"][1:]
    assert "b.jsonl" in error
    assert {r["path"][-7:] for r in st.read("files").collect()} == {"a.jsonl"}
    (tmp_path / "away").rename(logs / "b.jsonl")
    assert S.sync(st, [source])["errors"] == []
    assert stored(st) == once(spark, "pi", logs)
    run = [tuple(x) for x in st.read("runs").where("error IS NOT NULL").select("status").collect()]
    assert len(run) == 2


def usage(i, **more):
    return {"type": "message", "id": f"n{i}", "sessionId": "s", "role": "assistant", "timestamp": AT.format(i), "usage": {"input": i, "output": 1}} | more


def test_commits_decide_which_snapshot_stands(spark, tmp_path):
    """Three runs over files whose names run backwards; replays, a rewrite, a moved and a missing file add nothing."""
    logs, st = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 4)
    logs.mkdir()
    source = S.Source("s", "pi", f"file://{logs}")
    for k, name in enumerate("zma"):
        (logs / f"{name}.jsonl").write_bytes(dump([usage(i, usage={"input": 10 * k + i, "output": 1}) for i in range(3 - k)] + [["broken"]]))
        S.sync(st, [source])
    value = lambda: {r["request_id"]: r["fresh_input_tokens"] for r in st.read("facts").collect()}
    assert value() == {"s:n0": 20, "s:n1": 11, "s:n2": 2}
    assert st.read("bronze").where("kind = 'quarantine'").count() == 3
    before = stored(st)
    # Written again as it was, at another time; and one file under another name.
    os.utime(logs / "z.jsonl", (5, 5))
    (logs / "m.jsonl").rename(logs / "moved.jsonl")
    S.sync(st, [source])
    assert [x for x in stored(st) if "usage" in x] == [x for x in before if "usage" in x] and value()["s:n1"] == 11
    assert {(r["path"][-7:], r["present"]) for r in st.read("files").collect()} == {("a.jsonl", True), ("z.jsonl", True), ("m.jsonl", False), ("d.jsonl", True)}
    # Truncated and written anew.
    (logs / "a.jsonl").write_bytes(dump([usage(0, usage={"input": 99, "output": 1})]))
    S.sync(st, [source])
    assert value()["s:n0"] == 99
    counted = S.counters(st).first()
    assert (counted["files"], counted["harness_events"], counted["duplicates"]) == (4, 3, 4)


def test_versions_renormalising_rebuilding_and_cleaning(spark, tmp_path, monkeypatch):
    logs, st = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 4)
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(dump([usage(i) for i in range(6)]))
    source = S.Source("s", "pi", f"file://{logs}")
    S.sync(st, [source])
    first = stored(st)
    old = st.commits()[-1]
    S.renormalise(st, Config(cutoff="2026-01-01T00:00:03"))
    assert sorted(r["request_id"] for r in st.read("facts").collect()) == ["s:n3", "s:n4", "s:n5"]
    assert st.read("facts", number=old).count() == 6
    monkeypatch.setitem(STEPS, "pi", STEPS["pi"]._replace(version="pi-next"))
    assert S.sync(st, [source])["imported"] == 6 and stored(st) == first
    assert [r[0] for r in st.read("files").select("version").collect()] == ["pi-next"]
    for i in range(6, 9):
        with (logs / "a.jsonl").open("ab") as f:
            f.write(dump([usage(i)]))
        S.sync(st, [source])
    st.compact(1)
    assert all(len(f) == 1 for f in st.tables()["bronze"].parts.values())
    held = stored(st)
    st.vacuum(1)
    assert len(st.commits()) == 1 and stored(st) == held and len(held) == 9
    assert sum(len(os.listdir(tmp_path / "store" / "bronze" / c)) for c in os.listdir(tmp_path / "store" / "bronze")) == len(st.tables()["bronze"].parts)
    assert S.rebuild(st, [source])["imported"] == 9 and stored(st) == held and st.read("runs").count() > 10


def test_two_changes_from_one_commit(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store", 2)
    one, two = st.begin(), st.begin()
    rows = spark.range(4).select(F.col("id").cast("string").alias("id"))
    one.append("t", rows, "id")
    one.commit()
    two.append("t", rows, "id")
    with pytest.raises(RuntimeError, match="begin again"):
        two.commit()
    assert st.read("t").count() == 4


def test_directories_of_one_repository_are_one_project(spark, tmp_path):
    logs, st, repo = tmp_path / "logs", Store(spark, f"file://{tmp_path}/store", 2), tmp_path / "repo"
    logs.mkdir()
    (repo / ".git").mkdir(parents=True)
    (repo / "sub").mkdir()
    rows = [usage(i, sessionId=f"s{i}", cwd=str(folder)) for i, folder in enumerate((repo, repo / "sub", tmp_path, tmp_path / "gone"))]
    (logs / "a.jsonl").write_bytes(dump(rows))
    S.sync(st, [S.Source("s", "pi", f"file://{logs}")])
    ids = {r["logical_session_id"]: r["project_id"] for r in st.read("facts").collect()}
    assert ids["s0"] == ids["s1"] is not None
    assert len(set(ids.values())) == 3


def test_a_first_run_deals_rows_once_and_later_ones_agree(spark, tmp_path):
    """Equal records of two files count once, whether bronze is empty or not; lines of the first run are written with few shuffles."""
    row = lambda i: json.dumps({"id": f"n{i}", "sessionId": "s", "timestamp": AT.format(i), "usage": {"input": i}}) + "\n"
    (tmp_path / "a.jsonl").write_text("".join(row(i) for i in range(6)))
    (tmp_path / "b.jsonl").write_text("".join(row(i) for i in range(4)))
    st, sources = Store(spark, f"file://{tmp_path}/store", 4), [S.Source("one", "pi", f"file://{tmp_path}", "*.jsonl")]
    plans, real = {}, Change._write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Change, "_write", lambda self, name, rows, *a: plans.setdefault(name, rows._jdf.queryExecution().executedPlan().toString()) and real(self, name, rows, *a))
        assert S.sync(st, sources)["imported"] == 6
    # Rows without a directory or a header are not dealt for what these say: one exchange, of the records by their part.
    assert plans["bronze"].count("Exchange hashpartitioning") == 1
    (tmp_path / "c.jsonl").write_text("".join(row(i) for i in range(7)))
    assert S.sync(st, sources)["imported"] == 1
    assert sorted(r["fresh_input_tokens"] for r in st.read("facts").collect()) == list(range(7))


def test_chunks_of_lines_end_where_ranges_and_files_do(tmp_path):
    schema = S.to_arrow_schema(S.StructType.fromDDL(S._LINE))
    path, data = tmp_path / "a.log", b"one\r\n\n\xe2\x82\nthree \xff\nlast"
    path.write_bytes(data + b"\nlater\n")
    one = {"path": str(path), "cursor": 0, "size": len(data), "lines": 0, "modified_at": None}
    for step in (1, 5, 9, 100):
        ranges = [one | {"first": at, "last": min(at + step, len(data))} for at in range(0, len(data), step)]
        batch = S.pa.RecordBatch.from_pylist(ranges, S.pa.schema([("path", "string"), *((n, S.pa.int64()) for n in ("cursor", "size", "lines")), ("modified_at", schema.field("modified_at").type), ("first", S.pa.int64()), ("last", S.pa.int64())]))
        for chunk in (1, 4, 1000):
            rows = [r for b in S._read(iter([batch]), schema, 2, chunk) for r in b.to_pylist()]
            assert [r["text"] for r in rows if r["text"] is not None] == ["one", "", "\ufffd", "three \ufffd"]
            assert sum(r["ordinal"] for r in rows if r["text"] is None) == 4
            assert max(r["end"] for r in rows if r["text"] is None) == data.rindex(b"\n") + 1


def test_small_files_share_tasks_and_keep_their_lines(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.jsonl").write_text("".join(f"{i}-{n}\n" for n in range(i % 4 + 1)))
    plan = S.planned(S.listed(spark, S.Source("one", "pi", f"file://{tmp_path}")), spark.createDataFrame([], S.FILES), "v")
    assert S.new_lines(plan).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    # Ranges that weigh more than a file keep tasks of their own.
    assert S.new_lines(plan, 4).rdd.getNumPartitions() == 60 * 1 + sum(-(-sum(len(f"{i}-{n}\n") for n in range(i % 4 + 1)) // 4) - 1 for i in range(60))
    rows = S.new_lines(plan).collect()
    assert sorted(r["text"] for r in rows if r["text"] is not None) == sorted(f"{i}-{n}" for i in range(60) for n in range(i % 4 + 1))
    ends = {r["file"].rsplit("/", 1)[-1]: (r["ordinal"], r["end"]) for r in rows if r["end"] is not None}
    assert ends == {f"{i}.jsonl": (i % 4 + 1, (tmp_path / f"{i}.jsonl").stat().st_size) for i in range(60)}
