from collections import Counter

import pytest

from skein.llm import mixing as M

pytest.importorskip("public_tokenizers")
DOCS = "doc_id BIGINT, source STRING, text STRING, slot INT"
TARGETS = "source STRING, target_share DOUBLE, max_repeats INT"


def test_plan():
    size, shares = M.plan({"a": 100, "b": 100}, [("a", 0.8, 1), ("b", 0.2, 4), ("none", 0.5, 9)])
    assert size == 125 and [s for s, *_ in shares] == ["a", "b"]
    size, shares = M.plan({"a": 100, "b": 10}, [("a", 0.5, 3), ("b", 0.5, 2)], total=120)
    assert size == 120 and abs(dict((s, w) for s, w, _ in shares)["b"] - 20 / 120) < 1e-9
    assert M.plan({}, [("a", 1.0, 1)]) == (0, [])


@pytest.mark.parametrize("part", [7, 100_000])
def test_schedule(spark, part, monkeypatch):
    monkeypatch.setattr(M, "SLOT_BLOCK", part)
    shares = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    got = M.schedule(spark, 1000, shares).orderBy("slot").collect()
    for n in (64, 256, 1000):
        seen = Counter(r.source for r in got[:n])
        assert all(abs(seen[s] - w * n) <= 4 for s, w, _ in shares)
    for s, *_ in shares:
        assert [r.nth for r in got if r.source == s] == list(range(sum(r.source == s for r in got)))


def test_mix(spark):
    docs = [(i, s, f"word{i} " * (20 + i % 30), 0) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 60)]
    docs += [(5000, None, "x", 0), (5001, "other", "x", 0), (5002, "big", None, 0), (5003, "big", "", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 3), ("small", 0.1, 4), ("gone", 0.2, 2), ("mid", 0.1, 3)], TARGETS)
    mixed = M.mix(spark.createDataFrame(docs, DOCS), targets)
    rows = mixed.collect()
    most = {"big": 1, "mid": 3, "small": 4}
    times = Counter((r.source, r.doc_id) for r in rows)
    assert max(Counter((r.doc_id, r.repeat) for r in rows).values()) == 1
    assert all(n <= most[s] for (s, _), n in times.items())
    total = sum(r.tokens for r in rows)
    share = {s: sum(r.tokens for r in rows if r.source == s) / total for s in most}
    assert all(abs(share[s] - w) < 0.02 for s, w in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    reported = {r.source: r for r in M.shares(mixed, targets.dropDuplicates(["source"])).collect()}
    assert reported["gone"].tokens == 0 and abs(reported["big"].actual_share - share["big"]) < 1e-9
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(spark.createDataFrame(docs, DOCS), targets).collect()))


def test_a_small_source_leaves_the_others_blocks_alone(spark, monkeypatch):
    assert (M.block_tokens(10_000), M.block_tokens(10**12), M.block_tokens(3)) == (4, 8192, 1)
    monkeypatch.setattr(M, "MIN_BLOCKS", 4)
    docs = [(i, "big", "word " * 50, 0) for i in range(400)] + [(1000 + i, "tiny", "word " * 5, 0) for i in range(4)]
    targets = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.1, 100)], TARGETS)
    rows = M.mix(spark.createDataFrame(docs, DOCS), targets).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens for r in rows if r.source == "tiny") / total - 0.1) < 0.02
    # slots of the large source hold its own block size, not that of the tiny one
    slots = Counter(r.slot for r in rows if r.source == "big")
    assert len(slots) <= 8 and max(slots.values()) > 50


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert M.mix(docs, targets).count() == 0
    assert M.mix(spark.createDataFrame([(1, "a", "x y", 0)], DOCS), targets.limit(0)).count() == 0
