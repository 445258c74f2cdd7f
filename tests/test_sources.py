"""Readers of request logs and the bronze stream."""

import importlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from meterlake.functions.config import Config
from meterlake.functions.repository import with_roots
from meterlake.operators import normalize, store
from meterlake.sources import READERS, sqlite
from meterlake.sources.lines import finished_lines, fingerprint, logical_id, unchanged
from meterlake.sources.sqlite import MESSAGES
from meterlake.streaming import bronze

cursor, opencode = (importlib.import_module(f"meterlake.sources.{name}") for name in ("cursor", "opencode"))


@pytest.fixture
def read(spark):
    def run(harness, *records):
        lines = spark.createDataFrame([("f", i + 1, json.dumps(r)) for i, r in enumerate(records)], "file string, ordinal long, text string")
        return [r.asDict() for r in READERS[harness](lines).orderBy("ordinal").collect()]

    return run


def test_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_bytes(b"one\r\n\ntwo\nunfinished")
    (tmp_path / "y.jsonl").write_bytes("é\n".encode() * 3)
    (tmp_path / "z.jsonl").write_bytes(b"")
    (tmp_path / "n.txt").write_bytes(b"no\n")
    got = {(r["file"][-7:], r["ordinal"]): r["text"] for r in finished_lines(spark, str(tmp_path)).collect()}
    assert got == {("x.jsonl"[-7:], 1): "one", ("x.jsonl", 2): "", ("x.jsonl", 3): "two", ("y.jsonl", 1): "é", ("y.jsonl", 2): "é", ("y.jsonl", 3): "é"}


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.jsonl").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = finished_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in got] == text and [r["ordinal"] for r in got] == list(range(1, 5001))


def test_logical_id(spark):
    df = spark.createDataFrame([("/a/s1.jsonl",), ("/a/s1/subagents/x.jsonl",)], "file string")
    assert [r[0] for r in df.select(logical_id()).collect()] == ["s1", "s1:subagent:x"]


def test_fingerprint(spark):
    rows = [("a", 1, '{"b": 1, "a": 2}'), ("a", 2, ""), ("a", 3, "[1]"), ("b", 1, '{"a": 5, "b": "x"}'), ("b", 2, "[7]"), ("c", 1, '{"a": 5, "c": 1}'), ("c", 2, "broken")]
    lines = spark.createDataFrame(rows, "file string, ordinal long, text string")
    one, other = ({r["file"]: r["fingerprint"] for r in fingerprint(lines, v).collect()} for v in ("pi-1", "pi-2"))
    assert one["a"] == one["b"] != one["c"] and one["a"] != other["a"]


def test_repository_roots(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / "a" / "b").mkdir(parents=True)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: x")
    folders = [str(tmp_path / "repo" / "a" / "b"), str(tmp_path / "tree"), str(tmp_path / "gone"), None, ""]
    df = spark.createDataFrame([(f,) for f in folders], "cwd string")
    got = {r["cwd"]: r["root"] for r in with_roots(df).collect()}
    assert got == {folders[0]: str(tmp_path / "repo"), folders[1]: folders[1], folders[2]: folders[2], None: None, "": None}


def test_unchanged(spark):
    files = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 0, 1), ("d", 10, 1), ("e", 5, 1)], "path string, size long, modified_at long")
    before = spark.createDataFrame([("a", 10, 1, 10), ("b", 10, 1, 10), ("c", 0, 1, 0), ("d", 10, 1, 9)], "path string, size long, modified_at long, cursor long")
    assert [r["path"] for r in unchanged(files, before).collect()] == ["a"]


def claude_line(output, **more):
    usage = {"input_tokens": 10, "cache_read_input_tokens": 5, "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, "output_tokens": output}
    return {"type": "assistant", "uuid": "u", "requestId": "r", "timestamp": "2026-01-02T03:04:05.678Z", "message": {"id": "m", "model": "claude-x", "usage": usage}} | more


def test_claude(read):
    got = read("claude-code", {"type": "user", "sessionId": "s", "cwd": "/w"}, claude_line(30), claude_line(30), claude_line(300), claude_line(-1), claude_line(600))
    assert [r["kind"] for r in got] == ["usage", "duplicate", "usage", "quarantine", "usage"]
    assert got[3]["reason"] == "invalid-token-count"
    last = got[-1]
    assert (last["request_id"], last["logical_session_id"], last["cwd"], last["query_source"]) == ("m:r", "f", "/w", "main")
    assert (last["fresh_input_tokens"], last["cache_read_input_tokens"], last["cache_write_input_tokens"], last["output_tokens"]) == (10, 5, 7, 600)
    assert str(last["occurred_at"]) == "2026-01-02 03:04:05.678000"


def test_claude_without_identity_and_synthetic(read):
    got = read("claude-code", claude_line(1, uuid=None, requestId=None, message={"usage": {"output_tokens": 1}}), claude_line(2, message={"id": "n", "model": "<synthetic>", "usage": {"cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_5m_input_tokens": 9}}}))
    assert [r["reason"] for r in got] == ["missing-response-id", None]
    assert (got[1]["raw_model_id"], got[1]["cache_write_input_tokens"]) == (None, 9)


def vector(i, c, w, o, r, t):
    return {"input_tokens": i, "cached_input_tokens": c, "cache_write_input_tokens": w, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": t}


def codex_last(at, *v):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"last_token_usage": vector(*v)}}}


def codex_total(*v):
    return {"type": "event_msg", "payload": {"type": "token_count", "total_token_usage": vector(*v)}}


META = {"type": "session_meta", "session_id": "s", "model_provider": "openai", "cwd": "/w", "model": "gpt-5"}


def test_codex_requests(read):
    turn = {"type": "turn_context", "payload": {"model": "gpt-5.1", "turn_id": "t1"}}
    got = read("codex", META, turn, codex_last("2026-01-01T00:00:00Z", 100, 30, 10, 20, 8, 120), codex_last("2026-01-01T00:01:00Z", 100, 30, 10, 20, 8, 120), codex_last("2026-01-01T00:02:00Z", 10, 30, 0, 20, 8, 30))
    assert [(r["kind"], r["reason"]) for r in got] == [("usage", None), ("duplicate", None), ("quarantine", "impossible-cache-relationship")]
    one = got[0]
    assert (one["fresh_input_tokens"], one["cache_read_input_tokens"], one["cache_write_input_tokens"], one["output_tokens"], one["reasoning_output_tokens"]) == (60, 30, 10, 20, 8)
    assert (one["raw_provider_id"], one["raw_model_id"], one["turn_id"], one["cwd"]) == ("openai", "gpt-5.1", "t1", "/w")


def test_codex_running_totals(read):
    got = read("codex", META, codex_total(100, 0, 0, 10, 0, 110), codex_total(100, 0, 0, 10, 0, 160), codex_total(100, 0, 0, 10, 0, 160), codex_total(90, 0, 0, 10, 0, 150))
    assert [r["kind"] for r in got] == ["skipped", "usage", "duplicate", "quarantine"]
    assert got[1]["unattributed_tokens"] == 50 and got[3]["reason"] == "non-monotonic-cumulative"


def test_codex_replay_of_a_fork(read):
    """The replay is counted from the time at which the fork was named."""
    meta = META | {"source": {"subagent": {"x": 1}}, "timestamp": "2026-01-01T00:00:00Z"}
    burst = [codex_last(f"2026-01-01T00:00:0{s}Z", 50 + i, 0, 0, 5, 0, 55 + i) for i, s in enumerate(("0.000", "0.500", "0.900"))]
    got = read("codex", meta, *burst, codex_last("2026-01-01T00:00:09Z", 100, 0, 0, 25, 0, 125))
    assert [r["kind"] for r in got] == ["skipped"] * 3 + ["usage"]
    assert (got[3]["fresh_input_tokens"], got[3]["output_tokens"]) == (100, 25)
    late = codex_last("2026-01-01T00:01:00Z", 100, 0, 0, 25, 0, 125)
    assert [r["kind"] for r in read("codex", meta, late)] == ["usage"]
    assert [r["kind"] for r in read("codex", {k: v for k, v in meta.items() if k != "timestamp"}, burst[0])] == ["usage"]


def test_codex_names_of_forks(spark):
    cases = [({"source": "subagent"}, True), ({"source": "fork"}, True), ({"source": {"fork": None}}, True), ({"forked_from_id": "x"}, True), ({"forked_from_id": ""}, False), ({"source": "cli"}, False), ({"source": {"other": 1}}, False)]
    lines, want = [], {}
    for i, (more, forked) in enumerate(cases):
        for k, meta in enumerate(({"type": "session_meta", "payload": more}, {"session_meta": more}, {"type": "session_meta"} | more)):
            want[f"{i}-{k}"] = "skipped" if forked else "usage"
            lines += [(f"{i}-{k}", 1, json.dumps(meta | {"timestamp": 1767225600000})), (f"{i}-{k}", 2, json.dumps(codex_last("2026-01-01T00:00:00.100Z", 5, 0, 0, 5, 0, 10)))]
    got = READERS["codex"](spark.createDataFrame(lines, "file string, ordinal long, text string")).collect()
    assert {r["file"]: r["kind"] for r in got} == want


def test_codex_shapes_and_spellings(read):
    """The file is the session; every shape of an event and every spelling of a count is read; a missing total is none."""
    camel = {"inputTokens": 100, "cachedInputTokens": "20", "cacheWriteInputTokens": None, "outputTokens": 7.9, "reasoningOutputTokens": 3, "totalTokens": 120}
    token = lambda v: {"type": "token_count", "info": {"last_token_usage": v}}
    got = read(
        "codex",
        META,
        {"event_msg": {"payload": token(camel)}},
        {"type": "event_msg", "payload": {"payload": {"type": "token_count"}, "usage": {"input_tokens": 10, "total_tokens": 10}}},
        {"type": "token_count", "payload": {"payload": {"total_token_usage": {"input_tokens": 15, "cache_read_input_tokens": 4, "total_tokens": 15}}}},
        {"type": "event_msg", "payload": token({"input_tokens": 5, "output_tokens": 1})},
        {"type": "event_msg", "payload": token({"input_tokens": 5, "output_tokens": 1, "total_tokens": 0})},
        {"type": "event_msg", "payload": token({"input_tokens": -5, "total_tokens": 0})},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5}}}},
        {"type": "event_msg", "payload": [1]},
        {"type": "session_meta", "id": "second", "model": "other"},
        {"type": "event_msg", "payload": token({"input_tokens": 6, "total_tokens": 6})},
    )
    assert [(r["ordinal"], r["kind"], r["reason"]) for r in got] == [
        (2, "usage", None), (3, "skipped", None), (4, "usage", None), (5, "quarantine", "impossible-total-relationship"), (6, "duplicate", None), (7, "quarantine", "negative-token-count"), (11, "usage", None),
    ]
    one, delta = got[0], got[2]
    assert (one["logical_session_id"], one["request_id"]) == ("f", "f:2")
    assert (one["fresh_input_tokens"], one["cache_read_input_tokens"], one["cache_write_available"], one["output_tokens"], one["reasoning_output_tokens"], one["unattributed_tokens"]) == (80, 20, True, 7, 3, 13)
    assert (delta["fresh_input_tokens"], delta["cache_read_input_tokens"], delta["unattributed_tokens"], delta["cache_write_available"]) == (1, 4, 0, False)
    assert got[-1]["raw_model_id"] == "gpt-5"


def test_pi(read):
    usage = {"input": 100, "cacheRead": 20, "cacheWrite": 10, "cacheWrite1h": 4, "output": 30, "reasoning": 6, "totalTokens": 160, "cost": {"total": 0.25}}
    got = read("pi", {"type": "header", "id": "h", "cwd": "/w"}, {"type": "message", "id": "a", "role": "assistant", "parentId": "u", "message": {"provider": "zai", "model": "glm-5"}, "usage": usage}, {"type": "message", "id": "b", "usage": usage | {"totalTokens": 170, "input": -3}})
    one, two = got
    assert one["fresh_input_tokens"] + one["cache_read_input_tokens"] + one["cache_write_input_tokens"] == 130
    assert (one["unattributed_tokens"], one["request_id"], one["cost_nano_usd"], one["raw_provider_id"]) == (0, "h:a", 250_000_000, "zai")
    assert (two["fresh_input_tokens"], two["unattributed_tokens"]) == (0, 110)


def test_pi_spellings_and_turns(read):
    """Every spelling of a field counts; the turn is the nearest user message that the log has named so far."""
    got = read(
        "pi",
        {"type": "session_header", "uuid": "h", "cwd": "/w"},
        {"type": "message", "id": "u1", "role": "user"},
        {"type": "message", "id": "a1", "parent_id": "u1", "role": "assistant", "ts": "2026-01-02T03:04:05Z", "usage": {"input_tokens": 10, "cachedInput": 20, "cache_write": 30, "outputTokens": 40, "reasoning_tokens": 5, "total_tokens": 150, "cost_total": 0.5}},
        {"type": "tool", "id": "t1", "parentId": "a1", "role": "tool"},
        {"type": "message", "id": "a2", "parentId": "t1", "message": {"role": "assistant", "usage": {"inputTokens": "7", "output": 1.9, "costTotal": -1}}},
        {"type": "message", "id": "a3", "parentId": "u2", "usage": {"output": "many", "cacheWrite": None}},
        {"type": "message", "id": "u2", "role": "Human"},
        {"type": "message", "id": "a4", "parentId": "u2", "usage": {"output": 3}},
        {"type": "message", "id": "c1", "parentId": "c2", "usage": {"output": 3}},
        {"type": "message", "id": "c2", "parentId": "c1", "usage": {"output": 3}},
        {"type": "message", "id": "x", "usage": {"input_tokens": 3}},
        {"type": "message", "usage": {"output": 4}, "cwd": "/own"},
        ["no object"],
    )
    one = got[0]
    # A usage object is known by one of its plain names: this one has a total.
    assert [r["request_id"] for r in got] == ["h:a1", "h:a2", "h:a3", "h:a4", "h:c1", "h:c2", "h:line-12", None]
    assert [r["turn_id"] for r in got] == ["u1", "u1", None, "u2", None, None, None, None]
    assert (one["fresh_input_tokens"], one["cache_read_input_tokens"], one["cache_write_input_tokens"], one["output_tokens"], one["reasoning_output_tokens"], one["unattributed_tokens"], one["cost_nano_usd"]) == (10, 20, 30, 40, 5, 50, 500_000_000)
    assert (got[1]["fresh_input_tokens"], got[1]["output_tokens"], got[1]["cost_nano_usd"], got[1]["cache_write_available"]) == (7, 1, 0, False)
    assert (got[2]["output_tokens"], got[2]["cache_write_available"], got[2]["cost_nano_usd"]) == (0, True, None)
    assert (got[6]["cwd"], got[0]["cwd"], got[7]["kind"], got[7]["reason"]) == ("/own", "/w", "quarantine", "malformed-json")


def test_claude_turns_sides_and_times(spark):
    rows = [{"type": "user", "uuid": "p", "message": {"role": "user"}}, claude_line(1, uuid="q", parentUuid="p", timestamp="soon", isSidechain=True), claude_line(2, uuid="r", parentUuid="q", requestId="r2", message={"id": "n", "usage": {"output_tokens": 2}})]
    lines = spark.createDataFrame([("/p/s1/subagents/x.jsonl", i + 1, json.dumps(r), "2026-03-04 05:06:07") for i, r in enumerate(rows)], "file string, ordinal long, text string, modified_at string")
    got = READERS["claude-code"](lines).orderBy("ordinal").collect()
    assert [(r["logical_session_id"], r["turn_id"], r["query_source"]) for r in got] == [("s1:subagent:x", "p", "subagent"), ("s1:subagent:x", "p", "main")]
    assert str(got[0]["occurred_at"]) == "2026-03-04 05:06:07"


def assistant(**more):
    data = {"parentID": "u", "role": "assistant", "path": {"cwd": "/w"}, "cost": 0.5, "tokens": {"total": 200, "input": 100, "output": 20, "reasoning": 5, "cache": {"read": 30, "write": 10}}, "modelID": "m", "providerID": "p", "time": {"created": 1767323045678}}
    return json.dumps(data | more)


@pytest.fixture
def store_path(tmp_path):
    path = str(tmp_path / "opencode.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT PRIMARY KEY, project_id TEXT, parent_id TEXT, directory TEXT, time_created INT, time_updated INT)")
        db.execute("CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
        db.executemany("INSERT INTO session VALUES (?, 'x', ?, '/dir', 1, 1)", [("s", None), ("t", "s")])
        rows = [
            ("u", "s", json.dumps({"role": "user"})),
            ("a", "s", assistant()),
            ("b", "t", assistant(path={}, parentID="a", cost=-1, tokens={"input": 1, "output": "2"})),
            ("z", "s", assistant(tokens={"input": 0, "output": 0})),
            ("n", "s", assistant(tokens={"input": -1})),
            ("o", "s", assistant(tokens={})),
            ("j", "s", "{broken"),
        ]
        db.executemany("INSERT INTO message VALUES (?, ?, 5, ?, ?)", [(i, s, 10 + k // 2, d) for k, (i, s, d) in enumerate(rows)])
    return path


def test_opencode(spark, store_path):
    spark.dataSource.register(sqlite.Messages)
    messages = spark.read.format("sqlite_messages").option("rowsPerPartition", "2").load(store_path)
    assert messages.rdd.getNumPartitions() == 4
    got = {r["request_id"] or r["reason"]: r for r in READERS["opencode"](messages).collect()}
    assert {k: (r["kind"], r["reason"]) for k, r in got.items()} == {"a": ("usage", None), "b": ("usage", None), "z": ("skipped", None), "n": ("quarantine", "invalid-token-count"), "malformed-json": ("quarantine", "malformed-json")}
    a, b = got["a"], got["b"]
    assert (a["fresh_input_tokens"], a["cache_read_input_tokens"], a["cache_write_input_tokens"], a["output_tokens"], a["reasoning_output_tokens"], a["unattributed_tokens"], a["cost_nano_usd"]) == (100, 30, 10, 25, 5, 35, 500_000_000)
    assert (a["turn_id"], a["cwd"], a["query_source"], a["logical_session_id"], str(a["occurred_at"])) == ("u", "/w", "main", "s", "2026-01-02 03:04:05.678000")
    assert (b["turn_id"], b["cwd"], b["query_source"], b["output_tokens"], b["cost_nano_usd"], b["cache_write_available"], b["reasoning_output_tokens"]) == ("u", "/dir", "subagent", 2, None, False, None)


def test_store_without_messages(spark, store_path):
    with sqlite3.connect(store_path) as db:
        db.execute("DELETE FROM message")
    spark.dataSource.register(sqlite.Messages)
    assert spark.read.format("sqlite_messages").load(store_path).count() == 0


def test_opencode_snapshots(spark):
    """A delivery that changes nothing is a duplicate; another cost, place or model is not."""
    rows = [(1, "a", "s", 1, k, d, "/dir", None, k) for k, d in enumerate([assistant(), assistant(finish="stop"), assistant(cost=0.6), assistant(cost=0.6, path={"cwd": "/v"}), assistant(cost=0.6, path={"cwd": "/v"})])]
    df = spark.createDataFrame(rows, sqlite.MESSAGES + ", delivery long")
    got = READERS["opencode"](df).collect()
    assert sorted(r["kind"] for r in got) == ["duplicate", "duplicate", "usage", "usage", "usage"]


def test_message_stream_follows_its_watermark(spark, store_path, tmp_path):
    spark.dataSource.register(sqlite.Messages)

    def run():
        q = spark.readStream.format("sqlite_messages").load(store_path).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert first == sorted("uabznoj")
    assert run() == first
    with sqlite3.connect(store_path) as db:
        # The same instant as the last one taken, an older one updated, and one that stays.
        db.execute("INSERT INTO message VALUES ('k', 's', 5, 13, '{}')")
        db.execute("UPDATE message SET time_updated = 20 WHERE id = 'a'")
    assert run() == sorted([*first, "k", "a"])
    with sqlite3.connect(store_path) as db:
        # A store that went back is read again as a whole.
        db.execute("DELETE FROM message WHERE id NOT IN ('u', 'b')")
    assert run() == sorted([*first, "k", "a", "u", "b"])


def test_signature_of_a_store(store_path, tmp_path):
    assert opencode.signature(str(tmp_path / "none.db")) is None
    size, time = opencode.signature(store_path)
    (tmp_path / "opencode.db-wal").write_bytes(b"")
    (tmp_path / "opencode.db-shm").write_bytes(b"123")
    assert opencode.signature(store_path) == (size, time)
    (tmp_path / "opencode.db-wal").write_bytes(b"1234567")
    assert opencode.signature(store_path)[0] == size + 7


STOP = {"status": "completed", "conversation_id": "c", "generation_id": "g", "cursor_version": "1", "model": "old", "model_id": "m", "workspace_roots": ["/w"], "input_tokens": 10, "output_tokens": "20", "cache_read_tokens": 0, "user_email": "x@y", "prompt": "secret"}


def test_stop_payloads(spark):
    payloads = [
        STOP,
        STOP | {"workspace_roots": ["/w", "/v"], "timestamp": 1767323045678, "status": "odd", "input_tokens": -1, "output_tokens": 1.5},
        {"conversationId": "c", "generationId": "g2", "modelId": "n", "inputTokens": 3, "workspace_root": "/one", "occurredAt": "2026-01-02T03:04:05.5+01:00"},
        {"conversation_id": "c"},
        STOP | {"conversation_id": 7},
    ]
    df = spark.createDataFrame([(json.dumps(p), "2026-05-05T00:00:00.000Z") for p in payloads], "raw string, received_at string")
    one, two, three = (r.asDict() for r in cursor.sanitised(df).where("conversationId = 'c'").orderBy(F.desc("occurredAt")).collect())
    assert set(one) == set(cursor.NAMES)
    assert (one["workspaceRoot"], one["inputTokens"], one["outputTokens"], one["cacheReadTokens"], one["cacheWriteTokens"], one["flags"], one["timestampConfidence"], one["occurredAt"]) == ("/w", 10, 20, 0, None, None, "hook-receipt", "2026-05-05T00:00:00.000Z")
    assert (two["workspaceRoot"], two["flags"], two["status"], two["inputTokens"], two["outputTokens"], two["occurredAt"]) == (None, ["multi-root-project-ambiguous"], None, None, None, "2026-01-02T03:04:05.678Z")
    assert (three["modelId"], three["inputTokens"], three["workspaceRoot"], three["occurredAt"], three["timestampConfidence"]) == ("n", 3, "/one", "2026-01-02T02:04:05.500Z", "exact")
    assert cursor.sanitised(df, "/given").where("workspaceRoot <> '/given'").count() == 0


def event(**more):
    return {"schema": cursor.SCHEMA, "source": "stop-hook", "conversationId": "c", "generationId": "g", "modelId": "m", "inputTokens": 10, "outputTokens": 5, "occurredAt": "2026-01-02T03:04:05.000Z", "timestampConfidence": "exact"} | more


def test_cursor(read):
    got = read(
        "cursor",
        event(workspaceRoot="/w", cacheReadTokens=4, reasoningTokens=2),
        event(schema="v2"),
        event(outputTokens="x"),
        event(generationId=""),
        event(inputTokens=None, outputTokens=None, reasoningTokens=3),
        event(inputTokens=0, outputTokens=0),
        event(source="legacy-backfill", timestampConfidence="approximate", flags=["multi-root-project-ambiguous", "made-up"], modelId=None, legacyModel="old"),
        [1],
    )
    assert [(r["kind"], r["reason"]) for r in got] == [("usage", None), ("quarantine", "unknown-schema"), ("quarantine", "invalid-token-value"), ("quarantine", "malformed-json"), ("quarantine", "cursor-token-fields-missing"), ("skipped", None), ("usage", None), ("quarantine", "malformed-json")]
    assert got[0]["flags"] == ["cursor-input-semantics-unverified"]
    assert (got[0]["cwd"], got[0]["turn_id"], got[0]["cache_read_input_tokens"], got[0]["reasoning_output_tokens"], got[0]["cache_write_available"], str(got[0]["occurred_at"])) == ("/w", "g", 4, 2, False, "2026-01-02 03:04:05")
    assert got[6]["flags"] == ["multi-root-project-ambiguous", "historical-partial-accounting", "approximate-timestamp", "missing-cache-read"] and got[6]["raw_model_id"] == "old"


def bubble(usage=None, i=0, o=0, time=None, model=None):
    if model:
        return {"type": 1, "modelInfo": {"modelName": model}}
    return {"type": 2, "usageUuid": usage, "tokenCount": {"inputTokens": i, "outputTokens": o}} | ({"timingInfo": {"clientRpcSendTime": time}} if time else {})


def test_older_store(spark, tmp_path):
    path = str(tmp_path / "state.vscdb")
    values = {
        "bubbleId:c1:u1": bubble(model="gpt"), "bubbleId:c1:b1": bubble("x1", 10, 1, 1767323045678), "bubbleId:c1:u2": bubble(model="default"), "bubbleId:c1:b2": bubble("x2", 5, 5),
        "bubbleId:c1:u3": bubble(model="opus"), "bubbleId:c1:b3": bubble("x3", 7, 7), "bubbleId:c1:b0": bubble("x0", 1, 1), "bubbleId:c1:zero": bubble("x9", 0, 0), "bubbleId:c1:none": bubble(None, 3, 3),
        # Copies: equal; growing in time; not growing in time; growing in size; neither.
        "bubbleId:c2:e1": bubble("e", 4, 4), "bubbleId:c2:e2": bubble("e", 4, 4), "bubbleId:c2:t1": bubble("t", 9, 9, 300), "bubbleId:c2:t2": bubble("t", 1, 1, 100), "bubbleId:c2:w1": bubble("w", 9, 9, 100), "bubbleId:c2:w2": bubble("w", 1, 1, 300),
        "bubbleId:c2:s1": bubble("s", 2, 2), "bubbleId:c2:s2": bubble("s", 3, 2, 50), "bubbleId:c2:n1": bubble("n", 2, 3), "bubbleId:c2:n2": bubble("n", 3, 2), "bubbleId:odd": bubble("odd", 1, 1),
        "composerData:c1": {"createdAt": 1, "fullConversationHeadersOnly": [{"bubbleId": b} for b in ("b0", "u1", "b1", "u2", "b2", "u3", "b3")]}, "composerData:c2": {"createdAt": 1767323000000}, "other:1": {},
    }
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value BLOB)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, json.dumps(v).encode() if i % 2 else json.dumps(v)) for i, (k, v) in enumerate(values.items())])
    spark.dataSource.register(sqlite.KeyValues)
    read = lambda prefix: spark.read.format("sqlite_keys").option("prefix", prefix).load(path)
    assert read("bubbleId:").count() == sum(k.startswith("bubbleId:") for k in values)
    requests = cursor.attributed(cursor.bubbles(read("bubbleId:")), read("composerData:"))
    got = {r["usage_id"]: r for r in cursor.resolved_duplicates(requests).collect()}
    assert {k: r["model"] for k, r in got.items() if k.startswith("x")} == {"x0": None, "x1": "gpt", "x2": "gpt", "x3": "opus"}
    assert {k: (r["kept"], r["bubble"]) for k, r in got.items() if r["composer"] == "c2"} == {"e": (True, "e2"), "t": (True, "t1"), "w": (False, "w2"), "s": (True, "s2"), "n": (False, "n2")}
    headers = spark.createDataFrame([("c1", "w1", 1767323040000)], "composer string, workspace string, created_ms long")
    manifests = spark.createDataFrame([("w1", json.dumps({"folder": "file:///c%3A/My%20Work/a+b"}))], "workspace string, manifest string")
    events = cursor.legacy_events(cursor.resolved_duplicates(requests), read("composerData:"), headers, manifests, "2026-06-01T00:00:00.000Z")
    rows = {r["generationId"]: r for r in events.collect()}
    assert set(rows) == {"x0", "x1", "x2", "x3", "e", "t", "s"}
    assert (rows["x1"]["workspaceRoot"], rows["x1"]["timestampConfidence"], rows["x1"]["occurredAt"]) == ("c:/My Work/a+b", "exact", "2026-01-02T03:04:05.678Z")
    assert (rows["x2"]["timestampConfidence"], rows["x2"]["occurredAt"], rows["e"]["occurredAt"]) == ("approximate", "2026-01-02T03:04:00.000Z", "2026-01-02T03:03:20.000Z")
    spool = tmp_path / "backfill" / "import"
    first = cursor.write_spool(events, str(spool))
    assert cursor.write_spool(events, str(spool)) == first
    second = cursor.write_spool(events.where("generationId <> 'e'"), str(spool))
    assert second != first and [p.name for p in spool.iterdir()] == [second.rsplit("/", 1)[1]]
    records = READERS["cursor"](finished_lines(spark, str(spool))).collect()
    assert len(records) == 6 and all(r["kind"] == "usage" for r in records)


def older_store(folder, bubbles, headers, order=()):
    """A store with bubbles {(composer, bubble): value}, headers (composer, workspace, created) and conversations in order."""
    path = folder / "globalStorage" / "state.vscdb"
    path.parent.mkdir(parents=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE ON CONFLICT REPLACE, value BLOB)")
        db.execute("CREATE TABLE composerHeaders (composerId TEXT, workspaceId TEXT, createdAt INTEGER)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"bubbleId:{c}:{b}", json.dumps(v)) for (c, b), v in bubbles.items()])
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"composerData:{c}", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": b} for b in bs]})) for c, bs in dict(order).items()])
        db.executemany("INSERT INTO composerHeaders VALUES (?, ?, ?)", headers)
    return str(path)


AT = "2026-06-01T00:00:00.000Z"


def test_backlog_maps_workspaces_and_times(spark, tmp_path):
    found = {
        ("c1", "b1"): bubble("u1", 13816, 2251, 1747650422021) | {"text": "PROMPT"}, ("c1", "b2"): bubble("u2", 500, 50), ("c1", "b3"): bubble(None, 900, 90), ("c1", "b4"): bubble("u4", 0, 0),
        ("c2", "b"): bubble("u5", 1, 1), ("c3", "b"): bubble("u6", 1, 1), ("c4", "b"): bubble("u7", 1, 1), ("c5", "b"): bubble("u8", 1, 1), ("c6", "b"): bubble("u9", 1, 1),
    }
    headers = [("c1", "old", 1), ("c1", "ws-1", 1741209311788), ("c2", "empty-window", 5), ("c3", "gone", 5), ("c4", "bad", None), ("c5", "odd", "soon"), (None, "ws-1", 5)]
    path = older_store(tmp_path, found, headers)
    manifests = {"ws-1": '{"folder": "file:///c%3A/Users/j%20k/Code"}', "empty-window": '{"folder": "file:///no"}', "bad": "{", "odd": '{"folder": "vscode-remote://x/y"}', "deep/er": '{"folder": "file:///no"}'}
    for name, text in manifests.items():
        (tmp_path / "ws" / name).mkdir(parents=True)
        (tmp_path / "ws" / name / "workspace.json").write_text(text)
    events, told = cursor.backlog(spark, path, str(tmp_path / "ws"), AT)
    got = {r["generationId"]: r for r in events.collect()}
    assert [r.asDict() for r in told.collect()] == [{"status": "completed", "bubbles": 9, "positive": 7, "identities": 7, "imported": 7, "quarantined": 0, "exact": 1, "with_model": 0}]
    assert {r["workspaceRoot"] for r in (got["u1"], got["u2"])} == {"c:/Users/j k/Code"}
    assert (got["u1"]["occurredAt"], got["u1"]["timestampConfidence"]) == ("2025-05-19T10:27:02.021Z", "exact")
    assert (got["u2"]["occurredAt"], got["u2"]["timestampConfidence"]) == ("2025-03-05T21:15:11.788Z", "approximate")
    assert all(got[u]["workspaceRoot"] is None for u in ("u5", "u6", "u7", "u8", "u9"))
    # Without any time it is that of the reading.
    assert {u: got[u]["occurredAt"] for u in ("u5", "u7", "u8", "u9")} == {"u5": "1970-01-01T00:00:00.005Z", "u7": AT, "u8": AT, "u9": AT}
    assert "PROMPT" not in str(got)
    spool = cursor.write_spool(events, str(tmp_path / "spool"))
    assert cursor.write_spool(cursor.backlog(spark, path, str(tmp_path / "ws"), AT)[0], str(tmp_path / "spool")) == spool


def test_backlog_of_snapshots_and_models(spark, tmp_path):
    found = {
        ("c", "b1"): bubble("grows", 1504, 185, 1000), ("c", "b2"): bubble("grows", 15036, 4734, 2000), ("c", "b3"): bubble("same", 10, 5), ("c", "b4"): bubble("same", 10, 5), ("c", "b5"): bubble("torn", 100, 1), ("c", "b6"): bubble("torn", 50, 9),
        ("c", "m1"): bubble(model="grok"), ("c", "a1"): bubble("r1", 1, 1), ("c", "m2"): {"type": 1}, ("c", "a2"): bubble("r2", 1, 1), ("c", "m3"): bubble(model="default"), ("c", "a3"): bubble("r3", 1, 1), ("c", "m4"): bubble(model="sonnet"), ("c", "a4"): bubble("r4", 1, 1),
    }
    path = older_store(tmp_path, found, [("c", "empty-window", 1000)], {"c": ["m1", "a1", "m2", "a2", "m3", "a3", "m4", "a4"]})
    events, told = cursor.backlog(spark, path, str(tmp_path / "none"), AT)
    got = {r["generationId"]: r for r in events.collect()}
    assert {k: r["modelId"] for k, r in got.items()} == {"grows": None, "same": None, "r1": "grok", "r2": "grok", "r3": "grok", "r4": "sonnet"}
    assert got["grows"]["inputTokens"] == 15036
    assert told.select("identities", "imported", "quarantined", "with_model").collect() == [(7, 6, 1, 4)]


def test_backlog_without_store_or_table(spark, tmp_path):
    status = lambda: [(e.count(), *t.select("status", "bubbles", "imported").first()) for e, t in [cursor.backlog(spark, str(tmp_path / "x.vscdb"), str(tmp_path), AT)]]
    assert status() == [(0, "no-database", 0, 0)]
    with sqlite3.connect(tmp_path / "x.vscdb") as db:
        db.execute("CREATE TABLE unrelated (a)")
    assert status() == [(0, "no-table", 0, 0)]
    with sqlite3.connect(tmp_path / "x.vscdb") as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE, value BLOB)")
    assert status() == [(0, "completed", 0, 0)]


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_ranges_of_a_skewed_store_hold_equally_many_keys(spark, tmp_path, rows):
    """Nearly all keys begin alike: parts are within one key of each other and tile the prefix."""
    path = str(tmp_path / "s.db")
    keys = [f"bubbleId:aaaa:{i:04}" for i in range(300)] + ["bubbleId:0", "bubbleId:é", "bubbleId:\U0010ffff", "bubbleId:", "bubbleId;", "bubbleIc", "a", "z"]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE, value BLOB)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, 'v')", [(k,) for k in keys] + [(None,)])
    ranges = sqlite.key_ranges(path, "cursorDiskKV", "key", "bubbleId:", rows)
    want = sorted((k for k in keys if k.startswith("bubbleId:")), key=str.encode)
    sizes = [sum(a <= k < b for k in want) for a, b in ranges]
    assert sum(sizes) == len(want) and max(sizes) - min(sizes) <= 1 and max(sizes) <= rows
    assert ranges[0][0] == "bubbleId:" and ranges[-1][1] == "bubbleId;" and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    spark.dataSource.register(sqlite.KeyValues)
    df = spark.read.format("sqlite_keys").option("prefix", "bubbleId:").option("rowsPerPartition", max(rows, 64)).load(path)
    assert sorted((r["key"] for r in df.collect()), key=str.encode) == want
    assert sum(b is None for _, b in sqlite.key_ranges(path, "cursorDiskKV", "key", "", rows)) == 1


def test_spool_order(spark):
    files = ["/s/live/2026-01-01/a.jsonl", "/s/backfill/import/z.jsonl", "/s/live/2025-12-31/b.jsonl"]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    assert [r[0] for r in df.orderBy(cursor.spool_order()).collect()] == [files[1], files[2], files[0]]


@pytest.mark.parametrize(
    ("value", "bad"),
    [
        ({"prompt": "x"}, True), ({"Prompt": "x"}, True), ({"prompt": ""}, False), ({"input": 5, "output": 7}, False), ({"input": {"a": 1}}, True), ({"content": []}, True), ({"a": [{"b": {"text": "t"}}]}, True), ({"note": 'he said "content": "x"'}, False),
        ({"note": 'ends with \\', "text": "y"}, True), ({"code": None}, False), ({"code": True}, False), ({"a": {"a": {"a": {"a": {"a": {"a": {"code": "x"}}}}}}}, True), ({"a": {"a": {"a": {"a": {"a": {"a": {"a": {"code": "x"}}}}}}}}, False), ({"empty": "", "x": {"y": "", "body": "b"}}, True), ({}, False),
    ],
)
def test_guard(spark, value, bad):
    df = spark.createDataFrame([(json.dumps(value), "usage", None), (json.dumps(value, indent=1), "usage", None), (None, "usage", None)], "context string, kind string, reason string")
    got = [(r["kind"], r["reason"]) for r in normalize.guarded(df, "context").collect()]
    hit = ("quarantine", "forbidden-content-detected") if bad else ("usage", None)
    assert got == [hit, hit, ("usage", None)]


def test_from_lines_to_facts(spark, read, tmp_path):
    """A log is read, stored twice and normalised: the last snapshot counts once, under the config of today."""
    lines = [{"type": "user", "sessionId": "s", "cwd": "/w/app"}, claude_line(111), claude_line(222), claude_line(222), claude_line(-1)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in lines))
    for batch in (0, 1):
        records = READERS["claude-code"](finished_lines(spark, str(tmp_path / "logs")))
        bronze.append(normalize.raw(records, "claude-code", "one"), f"{tmp_path}/bronze", batch)
    held = spark.read.parquet(f"{tmp_path}/bronze")
    assert {(r["kind"], r["count"]) for r in held.groupBy("kind").count().collect()} == {("usage", 2), ("duplicate", 1), ("quarantine", 1)}
    (fact,) = (r.asDict() for r in normalize.facts(held).collect())
    assert (fact["output_tokens"], fact["processed_tokens"], fact["canonical_provider_id"], fact["provider_resolution"], fact["canonical_model_id"]) == (222, 10 + 5 + 7 + 222, "anthropic", "model-owner", "anthropic/claude-x")
    assert (fact["quality_flags"], fact["session_id"], fact["request_id"]) == (["missing-reasoning", "missing-cost"], "claude-code:s", "m:r")
    assert normalize.facts(held, Config(cutoff="2027-01-01")).count() == 0
    (n,) = (r.asDict() for r in normalize.routed(held).collect())
    assert (n["imported"], n["duplicates"], n["quarantined"]) == (2, 1, 1)


def test_envelope_hash_ignores_the_order_of_columns(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "", 1)], "a string, b string, c long")
    one, two = ([r[0] for r in df.select(normalize.envelope_hash(df, names)).collect()] for names in (["a", "b", "c"], ["c", "b", "a"]))
    assert one == two and one[0] != one[1] and all(len(x) == 32 for x in one)


def test_replayed_records_of_any_kind_add_nothing(spark, tmp_path):
    """Malformed lines and logs that name no session have the session of their file: their records have a key."""
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r1.jsonl").write_text("[1]\n" + json.dumps(codex_last(None, 5, 0, 0, 5, 0, 10)) + "\nbroken\n")
    for batch in (0, 1, 2):
        bronze.append(normalize.raw(READERS["codex"](finished_lines(spark, str(tmp_path / "logs"))), "codex", "one", batch), f"{tmp_path}/bronze", batch)
    held = spark.read.parquet(f"{tmp_path}/bronze")
    assert held.count() == 3 and {r[0] for r in held.select("logical_session_id").collect()} == {"r1"}


def test_commits_order_the_snapshots_of_a_request(spark):
    rows = lambda file, n: READERS["claude-code"](spark.createDataFrame([(file, 1, json.dumps(claude_line(n)))], "file string, ordinal long, text string"))
    older, newer = normalize.raw(rows("/x/b/s.jsonl", 1), "claude-code", "one", 1), normalize.raw(rows("/x/a/s.jsonl", 9), "claude-code", "one", 2)
    assert [r["output_tokens"] for r in normalize.facts(older.union(newer)).collect()] == [9]
    spools = ["/s/live/2026-01-01/s.jsonl", "/s/backfill/import/s.jsonl"]
    both = normalize.raw(rows(spools[0], 2).union(rows(spools[1], 1)), "claude-code", "one", 1)
    assert [r["output_tokens"] for r in normalize.facts(both).collect()] == [2]


def test_run_log_and_clearing(spark):
    rows = [("r1", 1, "2026-01-01 00:00:00", "running", 1, 5, 1, 0, None), ("r1", 2, "2026-01-01 00:01:00", "running", 1, 2, None, 3, "disk"), ("r1", 3, "2026-01-01 00:02:00", "completed", None, None, None, None, "late"), ("r2", 1, "2026-01-02 00:00:00", "running", None, None, None, None, None)]
    entries = spark.createDataFrame(rows, "run_id string, seq long, at string, status string, files long, imported long, duplicates long, quarantined long, error string").selectExpr("* EXCEPT (at)", "cast(at AS timestamp_ntz) AS at")
    log = store.run_log(entries)
    assert [tuple(map(str, r)) for r in log.orderBy("run_id").collect()] == [("r1", "2026-01-01 00:00:00", "2026-01-01 00:02:00", "completed", "2", "7", "1", "3", "disk; late"), ("r2", "2026-01-02 00:00:00", "None", "running", "0", "0", "0", "0", "None")]
    assert store.recent_runs(log, 1).first()["run_id"] == "r2"
    empty = store.cleared(entries)
    assert empty.columns == entries.columns and empty.count() == 0


def test_bronze_stream_is_idempotent(spark, tmp_path):
    schema = "logical_session_id string, line_ordinal long, envelope_hash string, seq long"
    rows = lambda *r: spark.createDataFrame(r, schema)
    rows(("s", 1, "a", 1), ("s", 2, "b", 2), ("s", 2, "b", 3)).write.parquet(f"{tmp_path}/in/one")

    def run():
        bronze.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/bronze", f"{tmp_path}/cp").awaitTermination(60)
        return sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/bronze").collect())

    assert run() == [1, 2]
    rows(("s", 2, "b", 9), ("s", 3, "c", 10)).write.parquet(f"{tmp_path}/in/two")
    assert run() == [1, 2, 10]
    assert run() == [1, 2, 10]
    bronze.append(rows(("s", 2, "b", 9), ("s", 3, "c", 10)), f"{tmp_path}/bronze", 1)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/bronze").collect()) == [1, 2, 10]


def test_a_message_delivered_again_has_its_latest_node(spark):
    """The answer hangs below a message that moved from one user to another; deliveries come in any order."""
    def message(delivery, rowid, id_, **data):
        return (rowid, id_, "s", 1, delivery, json.dumps(data), None, None, delivery)

    rows = [
        message(1, 1, "u1", role="user"), message(1, 2, "u2", role="user"), message(3, 3, "m", role="assistant", parentID="u2"), message(1, 3, "m", role="assistant", parentID="u1"),
        message(1, 4, "a", role="assistant", parentID="m", tokens={"input": 1}),
    ]
    for some in (rows, rows[::-1]):
        (got,) = READERS["opencode"](spark.createDataFrame(some, f"{MESSAGES}, delivery long")).select("request_id", "turn_id").collect()
        assert tuple(got) == ("a", "u2")


@pytest.mark.parametrize("harness", ["claude-code", "codex", "cursor", "opencode", "pi"])
def test_what_follows_the_parsing_does_not_parse_again(spark, harness):
    """No expression of the finished plan looks at the JSON text: filters and windows read what was parsed once."""
    text = '{"type": "session_meta", "role": "assistant", "usage": {"input": 1}, "tokens": {"input": 1}}'
    if harness == "opencode":
        row = (1, "a", "s", 1, 1, text, None, None)
        lines = spark.createDataFrame([row], "rowid long, id string, session_id string, time_created long, time_updated long, data string, session_directory string, session_parent_id string")
    else:
        lines = spark.createDataFrame([("/x/a.jsonl", 1, text)], "file string, ordinal long, text string")
    plan = READERS[harness](lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "data#" not in plan
    assert "parse" not in plan.replace("parsed", "") and "get_json_object" not in plan
