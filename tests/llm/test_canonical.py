import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import canonical as C


def slow(text):
    return unicodedata.normalize("NFC", "".join(C._expand(c) for c in text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_equals_the_slow_way(texts):
    texts = [t for t in texts if all(not 0xD800 <= ord(c) < 0xE000 for c in t)]
    assert C.canonical_array(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_marks_and_syllables():
    r = random.Random(3)
    pool = [chr(p) for p in (*range(0x41, 0x7B), *range(0x300, 0x330), 0x323, 0x31B, *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0xAC00, 0x9C7, 0x9BE, 0x9D7)]
    texts = ["".join(r.choice(pool) for _ in range(10)) for _ in range(2000)]
    assert C.canonical_array(pa.array(texts)).to_pylist() == [slow(t) for t in texts]


def test_forms():
    pairs = {"Ｆｕｌｌ－ｗｉｄｔｈ": "Full-width", "ﬁnd ﬂow": "find flow", "a​b­c﻿": "abc", "no break‑here": "no break-here", "сору": "copy", "é": "é", "ΑΒΕ": "ABE", "Ⅷ": "VIII"}
    assert C.canonical_array(pa.array(list(pairs))).to_pylist() == list(pairs.values())
    kept = ["É", "e", "x²", "①", "“q”", "–", "ß", "Straße", "日本語", "emoji 🎉"]
    assert C.canonical_array(pa.array(kept)).to_pylist() == kept


def test_nulls_empty_and_slices(monkeypatch):
    monkeypatch.setattr(C, "SLICE_POINTS", 5)
    texts = [None, "", "ﬁ" * 40, None, "abc", "é" * 3, ""]
    assert C.canonical_array(pa.array(texts)).to_pylist() == [None, "", "fi" * 40, None, "abc", "é" * 3, ""]
    assert C.canonical_array(pa.array(texts).slice(2, 3)).to_pylist() == ["fi" * 40, None, "abc"]
    assert C.canonical_array(pa.array([], pa.string())).to_pylist() == []


def test_columns_stay(spark, rows):
    df = spark.createDataFrame([("ﬁ", 1, "c"), (None, 2, "d"), ("ﬁ", 1, "c")], "text STRING, canonical INT, class_key STRING")
    assert rows(C.canonical(df)) == [("ﬁ", "c", "fi"), ("ﬁ", "c", "fi"), (None, "d", None)]
    assert C.canonical(df.limit(0)).count() == 0


def test_pairs(spark, rows):
    data = [(1, "same"), (2, "same"), (3, "ѕаmе"), (4, "Same"), (5, None), (6, None), (7, ""), (8, "​"), (9, "same"), (3, "ѕаmе")]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    assert rows(C.look_alike_pairs(df)) == [(1, 3), (2, 3), (3, 9), (7, 8)]
    assert C.look_alike_pairs(df.limit(0)).count() == 0
