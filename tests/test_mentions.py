import __spark_entry__ as entry
from skein.operators import graph

ENTITIES = "id STRING, name STRING"


def test_entity_mentions_equal_brute_force(spark, rows, monkeypatch):
    texts = [("a", "Ask ANNA about Köln and the parser"), ("b", "annabel, not the parsers"), ("c", None), ("d", ""), (None, "Anna")]
    own = [("1", "Anna"), ("2", "anna"), ("2", "anna"), ("3", "köln"), ("4", "Parser"), ("5", "bel, n"), ("6", "absent"), ("7", " "), ("8", None), (None, "Anna")]
    want = sorted({(k, i) for k, t in texts if k and t for i, n in own if i and n and n.strip() and n.lower() in t.lower()})
    concepts, entities = spark.createDataFrame(texts, "id STRING, content STRING"), spark.createDataFrame(own, ENTITIES)
    assert rows(graph.entity_mentions(concepts, entities)) == want
    monkeypatch.setattr(graph, "NAME_BLOCK", 5)
    assert rows(graph.entity_mentions(concepts, entities)) == want
    assert graph.entity_mentions(concepts, entities.limit(0)).count() == 0


def test_query_reads_entities(spark, tmp_path):
    schema = "conversation_id STRING, position INT, id STRING, role STRING, content STRING, model STRING, tokens INT"
    spark.createDataFrame([("c", 0, "m", "user", "TODO: rename the Zylophant folders", None, 1)], schema).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("e1", "zylophant"), ("e2", "Zylophant"), ("e3", "other")], ENTITIES).write.parquet(f"{tmp_path}/entities.parquet")
    assert {r.entity_id for r in entry.queries()["entity_mentions"](spark, str(tmp_path)).collect()} == {"e1", "e2"}
