import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm.splitting import IMBALANCE, PIECE, candidates, oversized, overlap_starts, split, split_texts


def check(text, limit, overlap):
    cuts = split(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in cuts)
    assert "".join(text[a + o : b] for a, b, o in cuts) == text
    assert all(o <= overlap for *_, o in cuts)
    if len(cuts) > 1:
        assert all(o >= int(overlap * 0.8) for *_, o in cuts[1:])
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n,;。é́"), min_size=1, max_size=900))
def test_round_trip(text):
    check(text, 60, 10)


def test_no_spaces_and_long_runs():
    check("x" * 9000, 2000, 200)
    check(("y" * 2500 + " ") * 4, 2000, 200)
    check("e" + "́" * 5000, 2000, 200)


def test_natural_boundaries():
    text = ("This is a sentence of some words. " * 200).strip()
    assert all(text[b - 2 : b] == ". " for _, b, _ in check(text, 2000, 200)[:-1])


def test_least_cost():
    """The cuts cost no more than any cuts that brute force tries."""
    r = random.Random(2)
    for _ in range(20):
        text = "".join(r.choice(["ab ", "cde. ", "f, ", "\n", "gh\n\n"]) for _ in range(14))
        limit, overlap = 20, 3
        at, penalty = candidates(text, limit, overlap)
        start = dict(zip(at.tolist(), overlap_starts(text, at, overlap).tolist())) | {0: 0}
        cost = dict(zip(at.tolist(), penalty.tolist()))
        even = len(text) / -(-(len(text) - overlap) // (limit - overlap))

        def price(ends):
            return sum(IMBALANCE * ((b - a) / even - 1) ** 2 + cost[b] + PIECE for a, b in zip([0, *ends], ends))

        def ways(a):
            if a == len(text):
                yield []
                return
            for b in at.tolist():
                if b > a and b - start[a] <= limit:
                    for rest in ways(b):
                        yield [b, *rest]

        if len(text) > limit:
            best = min(map(price, ways(0)))
            assert abs(price([b for _, b, _ in split(text, limit, overlap)]) - best) < 1e-9


def test_edges(spark, rows):
    assert split("", 10, 2) == [] and split("abc", 10, 2) == [(0, 3, 0)]
    with pytest.raises(ValueError):
        split("abc", 10, 10)
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "ab " * 30, "p"), (3, "ab " * 30, "p"), (4, "z" * 50, "p")], "id INT, text STRING, piece STRING")
    got = split_texts(df, F.col("text"), ["id"], 40, 5).collect()
    assert {r.id for r in got} == {3, 4} and all(len(r.text) <= 40 for r in got)
    assert {(r.id, r.nospace) for r in got} == {(3, False), (4, True)}


def test_both_tables(spark, rows):
    messages = spark.createDataFrame([("m", "word " * 500), ("n", "w" * 2001), ("o", "short"), ("p", None)], "id STRING, content STRING")
    conversations = spark.createDataFrame([("c", "line\n" * 500)], "id STRING, summary STRING")
    got = oversized(messages, conversations, with_text=False)
    assert rows(got.select("origin", "item_key", "nospace").distinct()) == [("message", "m", False), ("message", "n", True), ("summary", "c", False)]
    assert oversized(messages.limit(0), conversations.limit(0)).count() == 0
    assert all(re.search(r"\S{2001}", "w" * 2001) for _ in got.collect())
