import json

import pytest

from skein.sources import files, writers
from skein.streaming.incremental import daily_counts, index_notes, live_postings


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return path


def said(messages, conversation):
    own = [r for r in messages.orderBy("conversation_id", "position").collect() if r.conversation_id == conversation]
    return [(r.role, r.content, r.model) for r in own]


def test_claude(spark, tmp_path):
    m = lambda s, t, at, **k: {"uuid": t, "sender": s, "text": t, "created_at": at, **k}
    talk = {"uuid": "a", "name": "T", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [m("assistant", "yes", "2024-01-01T00:02:00Z", model="x"), m("human", "ok?", "2024-01-01T00:01:00Z"), m("alien", "no", None), m("human", " ", None), {"sender": "system", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}
    put(tmp_path, "a.json", {"conversations": [talk, {"uuid": "short", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [m("human", "x", None)]}]})
    put(tmp_path, "sub/b.json", [talk | {"uuid": "b"}, talk | {"uuid": None}, talk | {"uuid": "undated", "created_at": "soon"}])
    put(tmp_path, "bad.json", "{")
    conversations, messages = files.claude(spark, str(tmp_path))
    assert sorted(r.id for r in conversations.collect()) == ["a", "b"]
    assert said(messages, "a") == [("system", "p\nq", None), ("user", "ok?", None), ("assistant", "yes", "x")]
    assert conversations.where("id = 'a'").head().model == "x"


def test_chatgpt_and_gemini(spark, tmp_path):
    n = lambda parent, children, role, text: {"parent": parent, "children": children, "message": role and {"author": {"role": role}, "content": {"parts": [text, {"image": 1}]}, "create_time": 5.5, "metadata": {"model_slug": "g"}}}
    tree = {"r": n(None, ["u"], None, None), "u": n("r", ["a", "z"], "user", "hi"), "a": n("u", [], "assistant", "yo"), "z": n("u", [], "assistant", "other")}
    loop = {"s": n("gone", ["t"], "user", "1"), "t": n("s", ["s"], "assistant", "2")}
    put(tmp_path / "c", "c.json", [{"id": "c", "title": "t", "create_time": 1.5, "mapping": tree}, {"id": "l", "create_time": 1, "mapping": loop}, {"id": "e", "create_time": 1, "mapping": {}}])
    conversations, messages = files.chatgpt(spark, str(tmp_path / "c"))
    assert said(messages, "c") == [("user", "hi", "g"), ("assistant", "yo", "g")]
    assert {r.id for r in conversations.collect()} == {"c", "l"}
    put(tmp_path / "g", "g.json", {"id": "g", "name": "G", "create_time": "2024-01-01T00:00:00Z", "metadata": {"model_slug": "m"}, "entries": [{"id": "1", "role": "User", "parts": [{"text": "a"}, {"text": "b"}], "create_time": "2024-01-01T00:00:01Z"}, {"id": "2", "role": "Model", "parts": "c", "metadata": {"model_slug": "own"}, "create_time": "2024-01-01T00:00:02Z"}]})
    heads, turns = files.gemini(spark, str(tmp_path / "g"))
    assert said(turns, "g") == [("user", "a\nb", None), ("assistant", "c", "own")] and heads.head().model == "m"
    bare = spark.createDataFrame([("x", json.dumps({"id": "h", "entries": [{"role": "user", "parts": ["q"]}, {"role": "model", "parts": [{"text": "a"}], "metadata": {"model_slug": "own"}}]})), ("y", None), ("z", "")], "path STRING, text STRING")
    assert [r.model for r in files.gemini(spark, bare)[0].collect()] == ["own"]
    both, _ = files.ingest(spark, {"chatgpt": str(tmp_path / "c"), "gemini": str(tmp_path / "g")})
    assert both.count() == 3
    with pytest.warns(UserWarning, match="nowhere"):
        assert files.ingest(spark, {"nowhere": "x"})[0].count() == 0


def lines(*objects):
    return "\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects)


def test_cowork(spark, tmp_path):
    turn = lambda kind, content, **k: {"type": kind, "sessionId": "s", "cwd": "/home/x/proj", "message": {"role": kind, "content": content, "model": "m"}, "timestamp": "2024-01-01T00:00:00Z", **k}
    whole = lines(turn("user", "go"), turn("assistant", [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "name": "ls", "input": {"b": 1, "a": 2}}]), turn("user", "side", isSidechain=True), {"type": "queue-operation"}, "{broken")
    put(tmp_path, "one.jsonl", lines(turn("user", "old"), turn("assistant", "old")))
    put(tmp_path, "two.jsonl", whole)
    put(tmp_path, "audit1.jsonl", whole.replace('"s"', '"audit"'))
    put(tmp_path, "subagents/x.jsonl", whole.replace('"s"', '"sub"'))
    conversations, messages = files.cowork(spark, str(tmp_path))
    assert [(r.id, r.title) for r in conversations.collect()] == [("s", "proj")]
    assert said(messages, "s") == [("user", "go", None), ("assistant", 'ok\n\ntool_use ls: {"a":2,"b":1}', "m")]


def test_codex(spark, tmp_path):
    item = lambda kind, n=0, **p: {"timestamp": f"2024-01-01T00:00:0{n}Z", "type": kind, "payload": p}
    text = lambda role, t, n=0: item("response_item", n, type="message", role=role, content=[{"type": "t", "text": t}])
    put(tmp_path, "rollout-1.jsonl", lines(item("session_meta", id="s", cwd="/w/p"), item("turn_context", model="m1"), text("user", "<environment_context>"), text("user", "do", 1), item("response_item", 2, type="function_call", name="ls", arguments='{"a":1}'), item("turn_context", 2, model="m2"), item("response_item", 3, type="function_call_output", output="out"), text("assistant", "done", 4)))
    put(tmp_path, "rollout-2.jsonl", lines(item("session_meta", id="noone"), text("assistant", "a"), text("developer", "b")))
    put(tmp_path, "other.jsonl", lines(item("session_meta", id="x"), text("user", "a"), text("assistant", "b")))
    conversations, messages = files.codex(spark, str(tmp_path))
    assert [(r.id, r.title) for r in conversations.collect()] == [("s", "p")]
    assert said(messages, "s") == [("user", "do", "m1"), ("tool", 'ls: "{\\"a\\":1}"', "m1"), ("tool", "out", "m2"), ("assistant", "done", "m2")]


def test_calendar_and_vault(spark, tmp_path):
    events = [{"id": "1", "summary": "Sprint demo", "start": {"dateTime": "2024-03-01T23:30:00-05:00"}, "end": {"dateTime": "2024-03-02T00:30:00-05:00"}, "attendees": [{"email": "b"}, {"displayName": "a"}, {"email": "b"}]}, {"id": "2", "status": "cancelled", "start": {"date": "2024-03-01"}}, {"id": "3", "summary": "Off", "start": {"date": "2024-03-04"}}, {"id": "4"}]
    put(tmp_path / "c", "c.json", {"items": events})
    got = files.calendar(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [(r.id, str(r.day), r.kind, r.attendees) for r in got] == [("1", "2024-03-01", "meeting", ["a", "b"]), ("3", "2024-03-04", "event", [])]
    put(tmp_path / "v", "x/My note.md", "---\ntags: [a]\n---\nText")
    note = files.vault(spark, str(tmp_path / "v")).head()
    assert note.body == "Text" and note.meta == {"tags": "[a]"}


def test_writers(spark, tmp_path):
    conversations = spark.createDataFrame([("c", "A: title?", "claude", None, "m"), ("d", None, "claude", None, None), ("e", "A title", "claude", None, None)], "id STRING, title STRING, platform STRING, created_at TIMESTAMP, model STRING")
    messages = spark.createDataFrame([("c", 1, "assistant", "two"), ("c", 0, "user", "one")], "conversation_id STRING, position INT, role STRING, content STRING")
    writers.write_notes(writers.conversation_notes(conversations, messages), str(tmp_path / "out"))
    written = {p.name: p.read_text() for p in (tmp_path / "out/AI-Conversations").iterdir()}
    assert set(written) == {"A title.md", "Conversation d.md"}
    assert "platform: claude" in written["A title.md"]
    with pytest.raises(ValueError):
        writers.atomic_write(tmp_path / "x", "t", tmp_path / "out")
    writers.write_cards(spark.createDataFrame([("f\tx", "b\nc", ["a b", "c/d"])], "front STRING, back STRING, tags ARRAY<STRING>"), str(tmp_path / "cards"))
    assert spark.read.text(str(tmp_path / "cards")).head()[0] == "f x\tb<br>c\ta_b c::d"
    writers.write_graph(conversations.select("id"), messages.select("conversation_id"), str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/nodes")).count() == 3


def test_streams(spark, tmp_path):
    import datetime as dt

    def drain(writer):
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(120)

    schema = "event_id BIGINT, ts TIMESTAMP, event_type STRING"
    day = dt.datetime(2024, 1, 1)
    source = str(tmp_path / "events")
    spark.createDataFrame([(1, day, "a"), (1, day, "a"), (2, day, "a"), (3, day + dt.timedelta(days=9), "a")], schema).write.parquet(source)
    stream = daily_counts(spark.readStream.schema(schema).parquet(source))
    out = str(tmp_path / "days")
    drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "k1")))
    assert [(str(r.day), r.n) for r in spark.read.parquet(out).collect()] == [("2024-01-01", 2)]

    notes, folder = str(tmp_path / "notes"), str(tmp_path / "index")
    write = lambda *rows: spark.createDataFrame(list(rows), "path STRING, text STRING").write.mode("append").parquet(notes)
    write(("a", "apple pear"), ("b", "plum"))
    start = lambda: drain(index_notes(spark.readStream.schema("path STRING, text STRING").parquet(notes), folder, str(tmp_path / "k2")))
    start()
    write(("a", "apple pear"), ("b", "quince"))
    start()
    got = spark.read.parquet(f"{folder}/notes")
    assert sorted((r.path, r.batch) for r in got.collect()) == [("a", 0), ("b", 0), ("b", 1)]
    assert {r.term for r in spark.read.parquet(f"{folder}/postings").where("batch = 1").collect()} == {"quince"}
    write(("a", None), ("b", "damson"), ("b", "cherry"))
    start()
    assert {(r.path, r.term) for r in live_postings(spark, folder).collect()} == {("b", "damson")}
