import math

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph, index, topics


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return df.select(column.alias("x")).head()[0]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.tokens(c), t="The quick, quick FOX! a über x1") == ["quick", "quick", "fox", "ber", "x1"]
    assert one(spark, T.tokens(c), t="") == []
    assert one(spark, T.tokens(c), t=None) is None
    assert one(spark, T.word_count(c), t="  a b\n c ") == 3
    assert one(spark, T.phrase_count(T.spaced(T.words(c)), "code"), t="code code, decode Code.") == 3
    assert one(spark, T.phrase_count(T.spaced(T.words(c)), "machine learning"), t="Machine learning; machine, machine learning") == 2
    note = "---\ntitle: A: b\ntags: [x]\ntitle: last\n---\n\nBody\n"
    assert one(spark, T.front_matter(c), t=note) == {"title": "last", "tags": "[x]"}
    assert one(spark, T.body(c), t=note) == "Body"
    assert one(spark, T.front_matter(c), t="---\nopen: yes") == {}
    assert one(spark, T.body(c), t="plain") == "plain"
    assert one(spark, T.snippet(c, 10), t="one two\n\n three") == "one two …"
    assert one(spark, T.slug(c, 3), t="Fix: the Über-bug now!") == "fix-the-ber"
    assert one(spark, T.file_name(c), t=' a<b>:"c|?* ') == "abc"
    assert one(spark, T.note_type(c, F.lit("Vault/Decisions/x.md")), t="") == "decision"
    assert one(spark, T.note_type(c, F.lit("x.md")), t=None) == "note"
    assert one(spark, T.token_estimate(c), t="abc") == 1


def test_contradictions(spark):
    df = spark.createDataFrame([("We should use it", "We should not use it"), ("same", "same")], "a STRING, b STRING")
    flags = df.select("*", *(f.alias(f"a{i}") for i, f in enumerate(T.negation_flags(F.col("a")))), *(f.alias(f"b{i}") for i, f in enumerate(T.negation_flags(F.col("b")))))
    got = flags.select(T.contradicts([F.col(f"a{i}") for i in range(8)], [F.col(f"b{i}") for i in range(8)])).collect()
    assert [r[0] for r in got] == [True, False]


DOCS = [(1, "apple apple banana"), (2, "banana cherry"), (3, ""), (4, None), (5, "cherry cherry cherry banana")]


def brute_bm25(query):
    docs = {k: (t or "").split() for k, t in DOCS}
    live = {k: v for k, v in docs.items() if v}
    dl = {k: round(len(v) / min(v.count(t) for t in v)) for k, v in live.items()}
    avg = sum(dl.values()) / len(dl)
    out = {}
    for k, v in live.items():
        s = 0.0
        for t in query:
            raw = v.count(t) / len(v) * dl[k]
            df = sum(t in w for w in live.values())
            if raw:
                s += (math.log((1 + len(docs)) / (1 + df)) + 1) * raw * 2.5 / (raw + 1.5 * (0.25 + 0.75 * dl[k] / avg))
        if s:
            out[k] = s
    return out


def test_bm25(spark):
    df = spark.createDataFrame(DOCS, "doc_id INT, text STRING")
    got = {r.doc_id: r.score for r in index.bm25(df, "Cherry, apple cherry!").collect()}
    want = brute_bm25(["cherry", "apple", "cherry"])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert index.bm25(df, "the a").count() == 0
    assert index.bm25(df.limit(0), "apple").count() == 0


def test_tfidf_and_postings(spark):
    df = spark.createDataFrame(DOCS, "doc_id INT, text STRING")
    posted = index.postings(df)
    assert {(r.doc_id, r.term): r.n for r in posted.collect()}[1, "apple"] == 2
    scores = {r.doc_id: r.score for r in index.tfidf_cosine(posted, "apple", 5).collect()}
    assert set(scores) == {1} and 0 < scores[1] <= 1


def test_vectors_and_fusion(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "vec_id INT, embedding ARRAY<FLOAT>")
    query = spark.createDataFrame([([1.0, 0.0],)], "q ARRAY<FLOAT>")
    assert [r.vec_id for r in index.nearest(df, query, 3).collect()] == [1, 5, 2]
    lexical = spark.createDataFrame([(1, 2.0), (7, 1.0)], "doc_id INT, score DOUBLE")
    near = spark.createDataFrame([(1, 1.0), (8, 0.0)], "doc_id INT, similarity DOUBLE")
    assert [(r.doc_id, round(r.score, 3)) for r in index.fuse(lexical, near, 5).collect()] == [(1, 1.0), (7, 0.35), (8, 0.15)]
    assert [round(r.score, 2) for r in index.fuse(lexical, near.limit(0), 1).collect()] == [0.7]


def test_scores_that_differ_by_rounding_are_ties(spark):
    """Last digits depend on the order of the sums; the order of results doesn't."""
    lexical = spark.createDataFrame([(9, 2.0), (3, 2.0 - 1e-12), (4, 1.0)], "doc_id INT, score DOUBLE")
    near = spark.createDataFrame([], "doc_id INT, similarity DOUBLE")
    assert [r.doc_id for r in index.fuse(lexical, near, 2).collect()] == [3, 9]
    df = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 1e-7]), (1, [0.0, 1.0])], "vec_id INT, embedding ARRAY<DOUBLE>")
    assert [r.vec_id for r in index.nearest(df, spark.createDataFrame([([1.0, 0.0],)], "q ARRAY<DOUBLE>"), 2).collect()] == [2, 5]


def test_context_fits_budget():
    results = [{"title": f"t{i}", "snippet": "x" * 1200} for i in range(60)]
    got = index.context(results, "q", budget=1000)
    assert len(got) <= 4000 and got.startswith("# Vault context for: q\n\n## [1] t0") and "## [2]" in got
    assert index.context([], "q") == ""
    one = index.context([{"title": "T", "score": 0.5, "type": "note", "path": "a/b.md", "snippet": "some words here"}])
    assert one == "## [1] T  (score: 0.500)\n```yaml\ntype: note\nsource: b.md\n```\nsome words here"
    # a snippet that doesn't fit is tried again with less of it
    assert index.context([{"title": "T", "snippet": "w " * 500}], budget=150).endswith("…")
    assert index.context([{"title": "T", "snippet": "w " * 500}], budget=20) == ""


MESSAGES = "conversation_id STRING, position INT, id STRING, role STRING, content STRING, model STRING, tokens INT"


def test_concepts(spark, rows):
    data = [
        ("c", 0, "a", "user", "TODO: rename the folders\nWe decided to keep the old parser.", None, 1),
        ("c", 1, "b", "user", "todo: Rename the folders", None, 1),
        ("c", 2, "d", "user", "should be x.", None, 1),
        ("c", 3, "e", "user", None, None, 1),
    ]
    df = topics.deliveries(spark.createDataFrame([*data, data[0]], MESSAGES))
    got = rows(topics.concepts(df))
    assert got == [("c", "action_item", "rename the folders", 1), ("c", "decision", "to keep the old parser", 2)]
    assert topics.concepts(df, most=1).count() == 1
    assert topics.concepts(df.limit(0)).count() == 0


def test_topics(spark):
    df = spark.createDataFrame([("c", 0, "a", "user", "code code study", None, 1), ("d", 0, "b", "user", "", None, 1), ("e", 0, "f", "user", None, None, 1)], MESSAGES)
    got = [(r.conversation_id, r.rank, r.topic, r.confidence) for r in topics.topics_of(topics.topic_scores(df)).orderBy("rank").collect()]
    assert got == [("c", 1, "programming", 1.0), ("c", 2, "research", 1.0)]
    assert topics.tools_in(spark.createDataFrame([("c", 0, "a", "u", "Python, python and gogo", None, 1)], MESSAGES)).collect() == [("c", "python")]


ENTITIES = "id STRING, conversation_id STRING, ord INT, entity_type STRING, name STRING, aliases ARRAY<STRING>, first_seen TIMESTAMP, last_seen TIMESTAMP"


def test_canonical_by_name(spark, rows):
    data = [("1", "a", 0, "tool", "X", None, None, None), ("2", "b", 0, "person", "x", ["Y", "x"], None, None), ("3", "c", 0, "tool", "x", [], None, None), ("4", "d", 0, "tool", None, None, None, None), ("3", "c", 0, "tool", "x", [], None, None)]
    df = spark.createDataFrame(data, ENTITIES)
    merged = graph.canonical_by_name(df)
    assert rows(merged) == [("1", "1"), ("2", "2"), ("3", "1")]
    assert rows(graph.merged_aliases(df, merged)) == [("1", "x"), ("2", "Y")]
    assert rows(graph.merged_entities(df, merged).select("canonical_id", "members")) == [("1", 2), ("2", 1)]
    edges = spark.createDataFrame([("1", "3", 1), ("2", "3", 2), ("9", "3", 3)], "source_id STRING, target_id STRING, w INT")
    assert rows(graph.remap(edges, merged)) == [("2", "1", 2), ("9", "1", 3)]


def test_links(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None)], "s STRING, t STRING")
    assert rows(graph.neighbours(edges, "s", "t")) == [("a", "b"), ("b", "a")]
    texts = spark.createDataFrame([(1, "Anna met annabel"), (2, None), (3, "")], "k INT, t STRING")
    names = spark.createDataFrame([("ANNA",), (" ",), (None,), ("bel",)], "name STRING")
    assert rows(graph.mentions(texts, "k", "t", names)) == [(1, "anna"), (1, "bel")]
    assert graph.mentions(texts, "k", "t", names.limit(0)).count() == 0


def test_percentiles_and_histogram(spark, rows):
    df = spark.createDataFrame([(i / 10,) for i in range(1, 11)] + [(None,)], "v DOUBLE")
    assert rows(graph.percentiles(df, "v", [0.5, 0.95])) == [(0.5, 0.5), (0.95, 1.0)]
    assert dict(rows(graph.histogram(df, "v"))) == {0: 1, 1: 2, 2: 2, 3: 2, 4: 3}
    assert graph.percentiles(df.limit(0), "v", [0.5]).count() == 0


@pytest.mark.parametrize("name", ["conversation_stats", "topic_ranks", "concepts", "bm25_top", "entities_by_name", "codex_model_carried", "p1_found", "p6_found"])
def test_queries_run(spark, data, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, data).count() > 0


def test_sql_has_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
