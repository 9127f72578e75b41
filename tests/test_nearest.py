import math
import random

import __spark_entry__ as entry
from skein.operators import index

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>"


def brute(vectors, queries, k):
    whole = lambda v: v and None not in v and any(v)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = []
    for q, a in queries:
        if whole(a):
            near = sorted((-round(cos(a, b), 9), i) for i, b in vectors if whole(b) and len(a) == len(b))
            out += [(q, i, r, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_each_query_has_its_nearest(spark, monkeypatch):
    r = random.Random(5)
    data = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(300, None), (320, [0.0] * 4), (340, [1.0, None, 1.0, 1.0]), (360, [1.0, 2.0]), (361, [2.0, 4.0]), (380, [])]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = brute(data, [d for d in data if d[0] % 20 == 0], 7)
    monkeypatch.setattr(index, "QUERY_BLOCK", 6)
    got = sorted((x.query, x.vec_id, x.rank, x.similarity) for x in index.nearest_each(df, df.where("vec_id % 20 = 0"), 7).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))
    assert index.nearest_each(df, df.limit(0), 7).count() == 0


def test_query_asks_for_every_twentieth(spark, data):
    got = entry.queries()["vector_neighbours"](spark, data)
    asked = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 20 = 0 and embedding is not null").collect()}
    assert {r.query for r in got.collect()} == asked
