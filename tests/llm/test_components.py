import random

import pytest

from skein.llm.components import all_groups, components


def brute(pairs):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a and b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


SHAPES = {
    "star and chain": [("hub", f"x{i}") for i in range(40)] + [(f"x{i}", f"t{i}") for i in range(3)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)],
    "long tail": [("hub", f"x{i}") for i in range(10)] + [("x0", "l000")] + [(f"l{i:03}", f"l{i + 1:03}") for i in range(80)],
    "only a chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)],
    "cycles": [(f"a{i}", f"a{(i + 1) % 9}") for i in range(9)] + [("b1", "b2"), ("b2", "b1"), ("b1", "b1"), ("z", "z"), (None, "a1"), ("a1", ""), ("b1", "b2")],
    "empty": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    df = spark.createDataFrame([(a, b, 1) for a, b in SHAPES[shape]], "x STRING, y STRING, v INT")
    got = {r.member_key: r.group_key for r in components(df, "x", "y").collect()}
    assert got == {k: v for k, v in brute([(a, b) for a, b in SHAPES[shape] if a != b]).items()}


def test_random_graph(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randint(0, 300)}", f"n{r.randint(0, 300)}") for _ in range(180)]
    got = {x.member_key: x.group_key for x in components(spark.createDataFrame(pairs, "x STRING, y STRING"), "x", "y").collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])


def test_both_kinds(spark, rows):
    merges = spark.createDataFrame([("1", "2"), ("2", "0")], "merged_id STRING, canonical_id STRING")
    same = spark.createDataFrame([(" Ab ", "same_As", "cd"), ("cd", "USES", "ef"), (None, "SAME_AS", "x")], "subject STRING, predicate STRING, object STRING")
    assert rows(all_groups(merges, same)) == [("merge", "0", "1"), ("merge", "0", "2"), ("name", "ab", "cd")]
    assert all_groups(merges.limit(0), same.limit(0)).count() == 0
