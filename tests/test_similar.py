import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from skein.functions.text import REPLACING
from skein.operators import extraction as X
from skein.operators import similar as S

WORDS = ["use", "the", "old", "parser", "should", "not", "actually", "index", "switched to", "keep", "avoid"]


def statements(n, seed=1):
    r = random.Random(seed)
    return [(f"s{i:03}", r.choice(["decision", "action_item"]), " ".join(r.choice(WORDS) for _ in range(r.randint(2, 6))), r.randint(0, n), f"g{r.randint(0, 4)}") for i in range(n)]


SCHEMA = "id STRING, type STRING, text STRING, at BIGINT, `group` STRING"


def test_superseded_equals_brute_force(spark, rows, monkeypatch):
    import skein.plans.blocks as blocks

    data = statements(150)
    ordered = sorted(data, key=lambda s: (s[3], s[0]))
    want = {}
    for i, new in enumerate(ordered):
        if any(k in new[2] for k in REPLACING):
            for old in ordered[max(0, i - 7) : i]:
                if old[1] == new[1] and old[0] not in want and SequenceMatcher(None, old[2], new[2]).ratio() >= 0.4:
                    want[old[0]] = new[0]
    df = spark.createDataFrame(data, SCHEMA)
    assert dict(rows(S.superseded(df, look_back=7))) == want
    monkeypatch.setattr(blocks, "ROWS", 20)
    assert dict(rows(S.superseded(df, look_back=7))) == want
    assert S.superseded(df.limit(0)).count() == 0


def test_contradictions(spark, rows):
    data = [("a", "decision", "we should use the index", 1, "g"), ("b", "decision", "we should not use the index", 2, "h"), ("c", "decision", "we should not use the index", 3, "g"), ("d", "insight", "we should not use the index", 4, "h"), ("e", "decision", None, 5, "h")]
    got = rows(S.contradictions(spark.createDataFrame(data, SCHEMA)).select("id_a", "id_b"))
    assert got == [("a", "b")]


def test_numbered(spark):
    data = [(i, random.Random(i).randint(0, 9)) for i in range(200)]
    got = {r.i: r.rn for r in S.numbered(spark.createDataFrame(data, "i INT, at INT"), "at", ["i"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [i for i, _ in sorted(data, key=lambda x: (x[1], x[0]))]


def test_merged_concepts(spark, rows):
    schema = "conversation_id STRING, rank INT, concept_type STRING, content STRING, confidence DOUBLE"
    model = spark.createDataFrame([("c", 1, "decision", "Keep the old parser", 0.9), ("c", 2, "insight", "x", 0.95)], schema)
    rule = spark.createDataFrame([("c", 1, "decision", "keep  the old parsers", 0.9), ("c", 2, "decision", "drop all of it now", 0.9), ("c", 3, "decision", "drop all of it now!", 0.6), ("d", 1, "insight", "alone", 0.6)], schema)
    got = [(*r[:4], round(r[4], 3), r[5]) for r in rows(S.merged_concepts(rule, model))]
    assert got == [("c", 0, "decision", "Keep the old parser", 0.95, True), ("c", 1, "insight", "x", 0.95, False), ("c", 2, "decision", "drop all of it now", 0.75, True), ("d", 0, "insight", "alone", 0.6, False)]
    assert S.merged_concepts(rule.limit(0), model.limit(0)).count() == 0


def stub():
    """A factory that is sent to the tasks by value."""

    class Stub:
        def complete(self, prompt):
            if "fail" in prompt:
                raise ValueError("no")
            return prompt.upper()

    return lambda: Stub()


def test_extraction(spark, rows):
    texts = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "fail"), ("d", "known")], "conversation_id STRING, text STRING").withColumn("text_hash", F.sha2("text", 256))
    cache = spark.createDataFrame([], "text_hash STRING, stage STRING, prompt_version STRING, model STRING, result STRING")
    results, new = X.extract(texts, cache, "entity", "v1", "m", "do {text}", stub())
    assert sorted((r.result or r.error) for r in results.collect()) == ["DO KNOWN", "DO ONE", "ValueError: no"]
    cache = spark.createDataFrame(X.put(cache, new).collect(), cache.schema)
    _, again = X.extract(texts, cache, "entity", "v1", "m", "do {text}", stub())
    assert again.count() == 0
    _, other = X.extract(texts, cache, "entity", "v2", "m", "do {text}", stub())
    assert other.count() == 2
    assert rows(X.stage_counts(cache)) == [("entity", 2)]
    assert X.put(cache, new).count() == 2


def test_prompts_and_grounding(spark):
    messages = spark.createDataFrame([("c", 1, "b", "assistant", "y" * 60), ("c", 0, "a", "user", "hi"), ("c", 2, "d", "user", "late"), ("e", 0, "f", "user", None)], "conversation_id STRING, position INT, id STRING, role STRING, content STRING")
    got = {r.conversation_id: r.text for r in X.conversation_prompts(messages, tokens=10).collect()}
    assert got["c"].startswith("User: hi\n\nAssistant: yyy") and got["c"].endswith("[...]") and "late" not in got["c"]
    assert got["e"] == "User: "
    text = "We moved the old parser to a new home last night"
    df = spark.createDataFrame([("OLD parser", text), ("moved the very old parser to", text), ("nothing like it", text), ("", text), (None, text), ("x", None), ("one two three four five", "one two three four")], "q STRING, t STRING")
    assert [r[0] for r in df.select(X.grounded(F.col("q"), F.col("t"))).collect()] == [True, True, False, False, False, False, False]
