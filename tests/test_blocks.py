import random

from pyspark.sql import functions as F

from skein.plans.blocks import last_known, running_sum, with_block


def test_blocks_follow_the_order(spark):
    r = random.Random(1)
    data = [("hot", r.randint(0, 500)) for _ in range(3000)] + [("cold", i) for i in range(5)] + [("hot", None)]
    got = with_block(spark.createDataFrame(data, "k STRING, o INT"), ["k"], "o", rows=200).collect()
    hot = sorted(((tuple(x.block), -1 if x.o is None else x.o) for x in got if x.k == "hot"))
    assert len(got) == len(data)
    assert [o for _, o in hot] == sorted(o for _, o in hot)
    assert len({b for b, _ in hot}) > 5
    assert {tuple(x.block) for x in got if x.k == "cold"} == {()}


def test_equal_orders_are_cut_by_the_string(spark):
    r = random.Random(3)
    data = [("hot", r.choice([None, 7]), f"conversation-{r.randint(0, 10**6):06}") for _ in range(3000)] + [("hot", 7, "same")] * 50 + [(None, 1, None)] * 3 + [("start", i % 40, f"é{i}") for i in range(400)]
    df = spark.createDataFrame(data, "k STRING, o INT, t STRING")
    start = F.when(F.col("k") == "start", F.array(F.floor(F.col("o") / 20).cast("int"))).otherwise(F.array())
    got = with_block(df, ["k"], "o", rows=100, then="t", start=start).collect()
    assert sorted((x.k or "", x.o or -1, x.t or "") for x in got) == sorted((k or "", o or -1, t or "") for k, o, t in data)
    for key in ("hot", "start"):
        own = sorted((list(x.block), -1 if x.o is None else x.o, x.t) for x in got if x.k == key)
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
        sizes = {}
        for block, *_ in own:
            sizes[tuple(block)] = sizes.get(tuple(block), 0) + 1
        assert max(sizes.values()) <= 100


def test_running_sum_and_last_known(spark):
    r = random.Random(2)
    data = [(k, i, r.choice([None, None, None, f"v{i}"])) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(data, "k STRING, i INT, v STRING")
    got = {(x.k, x.i): x.out for x in last_known(df, ["k"], "i", "v", "out", rows=16).collect()}
    for k in "ab":
        seen = None
        for _, i, v in (d for d in data if d[0] == k):
            seen = v or seen
            assert got[k, i] == seen
    sums = running_sum(df.withColumn("b", F.floor(F.col("i") / 7)), ["k"], "b", ["i"], "i", "before").collect()
    assert all(x.before == x.i * (x.i - 1) // 2 for x in sums)


def test_empty(spark):
    empty = spark.createDataFrame([], "k STRING, i INT, v STRING")
    assert with_block(empty, ["k"], "i").count() == 0
    assert last_known(empty, ["k"], "i", "v", "out").count() == 0
