import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import curation as C
from skein.operators import graph

ENTITIES = "id STRING, conversation_id STRING, ord INT, entity_type STRING, name STRING, aliases ARRAY<STRING>, properties STRING, source_conversations ARRAY<STRING>, n INT"


def test_entities(spark, rows):
    data = [
        ("a", "c1", 0, "tool", "Kiln", ["Oven"], '{"x": 1, "y": "p"}', ["c1", None], 0), ("b", "c2", 0, "tool", "oven", None, '{"x": 2}', ["c2"], 0),
        ("c", "c3", 0, "person", "KILN", [], "{bad", None, 0), ("d", "c4", 1, "tool", None, ["kiln", None], None, ["c4", "c4"], 0), ("a", "c1", 0, "tool", "Kiln", ["Oven"], '{"x": 1, "y": "p"}', ["c1", None], 0), (None, None, None, "tool", "Kiln", None, None, None, 0),
    ]
    df = spark.createDataFrame(data, ENTITIES)
    canonical = C.canonical_by_any_name(df)
    assert rows(canonical) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "a")]
    assert rows(C.merged_properties(df, canonical)) == [("a", "x", "2"), ("a", "y", "p")]
    assert rows(C.merged_sources(df, canonical)) == [("a", "c1"), ("a", "c2"), ("a", "c4")]
    assert rows(C.all_names(df.where("id = 'a'"))) == [("a", "Kiln"), ("a", "Oven")]
    assert C.canonical_by_any_name(df.limit(0)).count() == 0


def test_platforms_and_provenance(spark, rows):
    payloads = ['[{"mapping": {}}]', '{"chat_messages": []}', '{"entries": 1, "mapping": 2}', "[]", "7", "{bad", None, '\ufeff{"entries": []}']
    got = C.platform_of(spark.createDataFrame(list(enumerate(payloads)), "k INT, payload STRING"))
    assert {r.k: r.platform for r in got.collect()} == {0: "chatgpt", 1: "claude", 2: "chatgpt", 3: None, 4: None, 7: "gemini"}
    heads = spark.createDataFrame([("i", "nobody", "codex", None, "", "slug"), ("j", "codex-cli", "other", "pipeline-synth-cluster", "s", None), ("k", None, None, None, None, None)], "id STRING, author STRING, platform STRING, ingested_by STRING, session_id STRING, session_slug STRING")
    assert rows(C.provenance(heads)) == [("i", "codex-cli", "pipeline-codex-ingester", "slug"), ("j", "codex-cli", "pipeline-synth-cluster", "s"), ("k", None, None, "k")]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(C.list_items(F.lit('[a, "b c", , x]'))) == ["a", "b c", "x"] and one(C.list_items(F.lit("solo"))) == ["solo"] and one(C.list_items(F.lit(""))) == []
    assert [one(C.value_kind(F.lit(v))) for v in ("", "[a]", "TRUE", "-1.5", "2024-01-02", "x")] == ["empty", "list", "boolean", "number", "date", "text"]
    assert one(C.single_domain(F.lit("python and coral"), F.array(F.lit("ai/Finance")))) == "finance" and one(C.single_domain(F.lit("zzz"), F.array().cast("array<string>"))) == "general"
    assert one(C.deck(F.lit("finance"))) == "Finance" and one(C.deck(F.lit("general"))) == "General"
    assert [round(one(C.grounded_confidence(F.lit(c).cast("double"), F.lit(k), F.lit(r))), 2) for c, k, r in ((0.9, 2, 1), (0.9, 0, 2), (0.4, 0, 3), (None, 0, 1), (0.2, 1, 9))] == [0.75, 0.6, 0.3, 0.35, 0.0]
    assert one(C.action_items(F.lit("- TODO: wash\n* [ ] dry\nAction items: fold\nplain"))) == ["wash", "dry", "fold"]


def test_due_cards(spark, rows):
    now = dt.datetime(2024, 2, 1)
    cards = spark.createDataFrame([("new", "h"), ("same", "h"), ("changed", "h"), ("fresh", "h"), ("unknown", "h"), ("", "h"), (None, "h")], "source_id STRING, card_hash STRING")
    past = spark.createDataFrame([("same", "h", now - dt.timedelta(days=30)), ("changed", "g", now - dt.timedelta(days=7)), ("fresh", "g", now - dt.timedelta(days=6, hours=23)), ("unknown", None, now)], "source_id STRING, exported_hash STRING, exported_at TIMESTAMP")
    due = lambda days: [r[0] for r in rows(C.due_cards(cards, past, F.lit(now), days).select("source_id"))]
    assert sorted(map(str, due(7))) == ["", "None", "changed", "new"]
    assert "fresh" in due(0)


def test_names_in_several_passes(spark, rows, monkeypatch):
    monkeypatch.setattr(graph, "NAME_BLOCK", 3)
    texts = spark.createDataFrame([(1, "an oven and a KILN"), (2, None), (3, "tin")], "k INT, t STRING")
    names = spark.createDataFrame([("Kiln",), ("oven",), ("tin",), (" ",), (None,)], "name STRING")
    assert rows(graph.mentions(texts, "k", "t", names)) == [(1, "kiln"), (1, "oven"), (3, "tin")]


def test_every_query_with_sql_is_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 70
