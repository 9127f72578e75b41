import random

import numpy as np
import pyarrow as pa

from skein.llm import leakage as L


def brute(docs, items, n):
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.casefold()).split()
    out = {}
    for d, t in docs:
        w = words(t or "")
        for i, s in items:
            v = words(s or "")
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                out[d, i] = best
    return out


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(2, 14))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, text(r.randint(0, 40))) for i in range(60)] + [(70, None), (71, ""), (72, items[0][1].upper().replace(" ", ", ")), (72, items[0][1].upper().replace(" ", ", "))]
    monkeypatch.setattr(L, "BLOCK_POINTS", 40)
    monkeypatch.setattr(L, "SPREAD_PLACES", 3)
    df, ds = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(x.doc_id, x.item_id): x.words for x in L.matches(df, ds, min_words=5).collect()}
    assert got == brute(docs, items, 5)
    assert {x.doc_id for x in L.without_leaks(df, ds, 5).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_disguised_passages(spark):
    passage = "the quick brown fox jumps over the lazy old dog today"
    other = passage.replace("o", "о").replace(" ", " ").replace("quick", "qu​ick").replace("fox", "Ｆｏｘ").replace("jumps", "jumps,\n")
    docs = spark.createDataFrame([(1, f"Before. {other} After."), (2, passage.replace("fox", "cat"))], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(4, passage)], "item_id BIGINT, text STRING")
    got = L.matches(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.words, r.doc_word, r.item_word) for r in got] == [(1, 4, 11, 1, 0)]


def test_suffix_array():
    r = np.random.default_rng(1)
    codes = r.integers(0, 3, 300).astype(np.int32)
    order = L.suffix_array(codes, 400)
    assert [tuple(codes[i:]) for i in order] == sorted(tuple(codes[i:]) for i in range(300))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "x " * 20)], "doc_id BIGINT, text STRING"), spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert L.matches(docs, items).count() == 0
    assert L.matches(docs.limit(0), spark.createDataFrame([(1, "x " * 20)], "item_id BIGINT, text STRING")).count() == 0
    keys, offsets = L.word_keys(pa.array(["", "a-b c", "-"]))
    assert len(keys) == 3 and offsets.tolist() == [0, 0, 3, 3]
