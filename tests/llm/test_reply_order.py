import random

from skein.llm.replies import position_graph, reply_order, reply_order_of

SCHEMA = "conversation_id STRING, id STRING, parent_id STRING, at BIGINT"




def kahn_order(data, conversation):
    """Kahn's algorithm, step by step: the least (at, id) of all rows whose parent has come."""
    own = {i: (p, at) for c, i, p, at in data if c == conversation}
    came = []
    while True:
        ready = [(at is not None, at or 0, i) for i, (p, at) in own.items() if i not in came and (p not in own or p in came)]
        if not ready:
            return came
        came.append(min(ready)[2])


def test_order_is_the_same_at_any_size(spark):
    r = random.Random(2)
    data = [("t", "r", None, 5), ("t", "s", None, 5), ("t", "c", "r", 1), ("e", "a", None, 5), ("e", "b", "a", 5), ("e", "c", None, 5)]
    data += [("v", "r1", None, 5), ("v", "x", "r1", 1), ("v", "r2", None, 5), ("v", "r0", None, 9), ("d", "a", None, 9), ("d", "b", "a", 8), ("d", "c", "b", 7), ("d", "e", None, 8)]
    data += [("x", f"{i:02}", r.choice([None, *(f"{j:02}" for j in range(i))]), r.choice([None, 1, 2, 3])) for i in range(40)]
    data += [("x", "p", "q", 1), ("x", "q", "p", 1), ("x", "z", "p", 1), ("x", "o", "gone", 2)]
    df = spark.createDataFrame([*data, data[0]], SCHEMA)
    small, large = ({(x.conversation_id, x.id): (x.step, x.depth if not x.cyclic else None, x.cyclic) for x in reply_order(df, n).collect()} for n in (4096, 2))
    assert small == large
    for c in "tevdx":
        got = sorted((step, i) for (own, i), (step, *_) in small.items() if own == c and step is not None)
        assert [i for _, i in got] == kahn_order(data, c) and [s for s, _ in got] == list(range(len(got)))
    assert [kahn_order(data, "v"), kahn_order(data, "t")] == [["r1", "x", "r2", "r0"], ["r", "c", "s"]]


def test_rows_of_one_position_go_by_time_and_gaps_are_second_roots():
    keys = [(True, p, k) for p, k in ((1, "b"), (0, "z"), (2, "c"), (1, "a"), (2, "d"))]
    assert reply_order_of([1, 0, 2, 1, 2], keys) == ([1, 3, 0, 2, 4], False)
    assert reply_order_of([0, 2, None], [(True, 0, ""), (True, 2, ""), (False, 0, "")]) == ([2, 0, 1], True)
    assert position_graph([0] * 500 + [1] * 500)[0].count(1000) == 500
    assert reply_order_of([], []) == ([], False)
