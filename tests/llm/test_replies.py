import datetime as dt
import json
import random

import pytest

from skein.llm.replies import broken_conversations, dropped, kahn, rebuilt_conversations, reply_order, unanswered_turns

MESSAGES = "conversation_id STRING, position INT, id STRING, role STRING, content STRING, ts STRING, ingested_at TIMESTAMP"
HEADERS = "id STRING, created_at STRING, updated_at TIMESTAMP, tz STRING"
DAY = dt.datetime(2024, 1, 1)


def test_kahn():
    assert kahn([-1, 0, 0, 1], [3, 2, 1, 0]) == [0, 2, 1, 3]
    assert kahn([1, 0, -1], [0, 0, 0]) == [2]
    assert kahn([], []) == []


@pytest.fixture
def chats(spark):
    data = {
        "good": [("user", "q"), ("assistant", "a"), ("tool", "t"), ("USER ", "q"), ("ai", "a")],
        "open": [("user", "q"), ("assistant", "a"), ("human", "q")],
        "twice": [("user", "q"), ("user", "q"), ("model", "a")],
        "silent": [("assistant", "a"), ("system", "s")],
        "blank": [("user", "q"), ("assistant", " ​\n"), ("assistant", None)],
        "odd": [("user", "q"), ("widget", "a")],
        "headless": [("user", "q"), ("assistant", "a")],
    }
    rows = [(c, i, f"{c}{i}", r, t, None, DAY) for c, turns in data.items() for i, (r, t) in enumerate(turns)]
    rows += [("gap", i, f"gap{i}", r, "x", None, DAY) for i, r in ((0, "user"), (2, "assistant"))]
    rows += [("timed", None, f"timed{i}", r, "x", ts, DAY) for i, (r, ts) in enumerate([("assistant", "2024-01-01 10:00:00 UTC"), ("user", "1704099600"), ("user", "2024-01-01T11:00:00Z"), ("assistant", "2024-01-01T11:00:01Z")])]
    rows += [rows[0], (None, 0, "lost", "user", "x", None, DAY)]
    heads = [(c, None, None, None) for c in [*data, "gap", "timed", "empty"] if c != "headless"]
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([*heads, heads[0], (None, None, None, None)], HEADERS)


WRONG = {"open", "twice", "silent", "blank", "odd", "headless", "gap", "empty"}


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_broken(chats, block):
    assert {r[0] for r in broken_conversations(*chats, block_rows=block).collect()} == WRONG


def test_rebuilt(chats):
    got = rebuilt_conversations(*chats).orderBy("conversation_id", "block", "step").collect()
    assert [r.id for r in got if r.conversation_id == "timed"] == ["timed1", "timed0", "timed2", "timed3"]
    assert [r.role for r in got if r.conversation_id == "good"] == ["user", "assistant", "tool", "user", "assistant"]
    assert {r.conversation_id for r in got} == {"good", "timed"}


def line(kind, **payload):
    return json.dumps({"type": kind, "payload": payload})


def test_turns(spark, rows):
    says = lambda role, text, **k: line("response_item", type="message", role=role, content=[{"type": "t", "text": text}], **k)
    lines = [
        says("user", "before any turn"), line("turn_context", turn_id="t1"), says("user", "<environment_context>x"), says("user", "hello"), says("assistant", "hi"),
        line("turn_context", turn_id="t2"), says("user", "again"), says("assistant", " "), says("assistant", "other", turn_id="t1"), says("user", "x", turn_id="t3"), line("turn_context", turn_id="t4"), says("user", " <permissions instructions>"),
        line("response_item", type="message", role="user", content="bare", turn_id="t5"), line("event_msg", type="message", role="assistant", content="no", turn_id="t5"), says("user", "cut")[:-3],
    ]
    df = spark.createDataFrame([(i, "s", i, x) for i, x in enumerate(lines)] + [(0, "s", 0, lines[0]), (99, "s", 99, None)], "rec_id BIGINT, session_file STRING, line_no INT, line STRING")
    assert rows(unanswered_turns(df)) == [("s", "t2"), ("s", "t3"), ("s", "t5")]


def test_empty_tables(spark, chats):
    codex = spark.createDataFrame([], "rec_id BIGINT, session_file STRING, line_no INT, line STRING")
    assert dropped(chats[0].limit(0), chats[1].limit(0), codex).count() == 0


def test_reply_graphs(spark):
    r = random.Random(6)
    data = []
    for c in range(12):
        n = r.choice([1, 5, 40])
        for i in range(n):
            parent = None if i == 0 else f"n{r.randint(0, i - 1)}"
            data.append((f"c{c}", f"n{i}", parent, r.randint(0, 5)))
    data += [("loop", "a", "b", 1), ("loop", "b", "a", 1), ("loop", "d", "a", 1), ("loop", "e", "gone", 1)]
    df = spark.createDataFrame([*data, data[0]], "conversation_id STRING, id STRING, parent_id STRING, at BIGINT")
    small = {(x.conversation_id, x.id): (x.step, x.depth, x.cyclic) for x in reply_order(df).collect()}
    large = {(x.conversation_id, x.id): (x.step, x.depth, x.cyclic) for x in reply_order(df, block_rows=16).collect()}
    assert small.keys() == large.keys() == {d[:2] for d in data}
    assert {k for k, v in small.items() if v[2]} == {k for k, v in large.items() if v[2]} == {("loop", "a"), ("loop", "b"), ("loop", "d")}
    for got in (small, large):
        for c, i, p, _ in data:
            if p and (c, p) in got and not got[c, i][2]:
                assert got[c, p][0] < got[c, i][0] and got[c, p][1] + 1 == got[c, i][1]
        for c in {d[0] for d in data}:
            steps = sorted(v[0] for k, v in got.items() if k[0] == c and not v[2])
            assert steps == list(range(len(steps)))
