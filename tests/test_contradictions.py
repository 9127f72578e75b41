import random
import re
from difflib import SequenceMatcher

import __spark_entry__ as entry
from skein.operators import similar as S
from skein.vocab import NEGATIONS

SCHEMA = "id STRING, type STRING, text STRING, at BIGINT, `group` STRING"
WORDS = ["Use", "the", "old", "parser", "should", "should not", "will", "won't", "avoid", "index", "do not", "does", "x"]


def brute(data, threshold=0.5):
    rows, out = sorted({s for s in data if s[2] is not None}, key=lambda s: (s[3] is not None, s[3] or 0, s[0])), set()
    flags = {s: [tuple(bool(re.search(p, s[2], re.IGNORECASE)) for p in pair) for pair in NEGATIONS] for s in rows}
    for i, b in enumerate(rows):
        for a in rows[:i]:
            if a[1] == b[1] and (a[4] is None or a[4] != b[4]) and any(x[1] != y[1] and (x[0] or y[0]) for x, y in zip(flags[a], flags[b])):
                r = SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio()
                if r >= threshold:
                    out.add((a[0], b[0], round(r, 3)))
    return out


def test_contradictions_equal_brute_force(spark):
    r = random.Random(3)
    data = [(f"s{i:03}", r.choice(["decision", "insight"]), " ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 4, 8, 60]))), r.choice([None, *range(40)]), r.choice([None, "g", "h", "i"])) for i in range(160)]
    data += [("n", "decision", None, 1, "g"), ("e", "decision", "", 1, "g"), data[0]]
    df = spark.createDataFrame(data, SCHEMA)
    for threshold in (0.5, 0.8):
        want = brute(data, threshold)
        got = S.contradictions(df, threshold).collect()
        assert len(got) == len(want) > 0 and {(x.id_a, x.id_b) for x in got} == {(a, b) for a, b, _ in want}
        weights = {(a, b): w for a, b, w in want}
        assert all(abs(x.weight - weights[x.id_a, x.id_b]) < 0.0011 for x in got)


def test_far_apart(spark, rows):
    data = [("a", "decision", "we should use the index", 0, "g"), *((f"f{i}", "decision", f"filler {i}", i, "g") for i in range(1, 80)), ("z", "decision", "we should not use the index", 99, "h")]
    assert [x[:2] for x in rows(S.contradictions(spark.createDataFrame(data, SCHEMA)))] == [("a", "z")]


def test_query_is_registered():
    assert "contradictory_concepts" in entry.queries()
