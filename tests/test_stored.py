import pytest

from skein.operators import index, stored

SCHEMA = "doc_id BIGINT, text STRING, note_type STRING, path STRING, kind INT"
NOTES = [
    (1, "---\ntype: decision\ntags: [Home, garden]\ndomain: living\n---\nprompt cache prompt cache stale", None, "a/x.md", 0),
    (2, "cache of prompts and schema", "insight", "Decisions/y.md", 0),
    (3, "schema validator keeps the cache", "", "Decisions/z.md", 0),
    (4, None, None, None, 0), (5, "", None, "w", 0), (6, "the of", None, "v", 0), (7, "unrelated words only", None, "u", 0),
]


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    df = spark.createDataFrame(NOTES, SCHEMA)
    folder = str(tmp_path_factory.mktemp("index"))
    stored.build(df, stored.note_fields(df), folder, buckets=3, files=2)
    return df, stored.open_index(spark, folder)


@pytest.mark.parametrize("query", ["prompt cache cache", "schema", "absent", "the of", ""])
def test_scores_are_those_of_the_plain_operators(opened, query):
    df, own = opened
    near = lambda d: {r.doc_id: round(r.score, 9) for r in d.collect()}
    assert near(own.bm25(query)) == near(index.bm25(df, query))
    assert near(own.cosine(query)) == near(index.tfidf_cosine(index.postings(df), query, df.count()))


def test_filters(opened):
    _, own = opened
    ids = lambda **k: sorted(r.doc_id for r in own.bm25("prompt cache schema", **k).collect())
    assert ids() == [1, 2, 3]
    assert ids(kind="DECI") == [1, 3] and ids(kind="insi") == [2]
    assert ids(tags="garden") == [1] and ids(domain="Liv", kind="decision") == [1] and ids(tags="none") == []
    assert sorted(r.doc_id for r in own.cosine("schema", kind="decision").collect()) == [3]
    assert {r.doc_id: r.title for r in own.table("notes").collect()} == {1: "x", 2: "y", 3: "z", 4: "", 5: "w", 6: "v", 7: "u"}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    stored.build(df, stored.note_fields(df), str(tmp_path))
    own = stored.open_index(spark, str(tmp_path))
    assert own.bm25("cache").count() == 0 == own.cosine("cache").count()


def test_postings_are_kept_in_blocks(spark, tmp_path):
    """A term stands once for many documents, and the postings are those of the columns."""
    odd = ["ab", "cd", "", "the", "x", "\u0130z \u212aelvin ca\u00dfe", "tab\tline\x0bfeed\u2028ends", "1a 22 1a", "a-b_cc.dd", None, "of"]
    rows = [(i, odd[i]) for i in range(len(odd))] + [(i, f"alpha beta {'gamma ' * (i % 3)}note-{i}") for i in range(100, 500)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(2)
    stored.build(df, df.select("doc_id"), str(tmp_path))
    own = stored.open_index(spark, str(tmp_path))
    blocks = own.table("postings").where("bucket >= 0")
    posted = {(r.doc_id, r.term, r.n, r.tf) for r in index.postings(df).collect()}
    assert {(k, r.term, n, n / t) for r in blocks.collect() for k, n, t in zip(r.key, r.n, r.total, strict=True)} == posted
    assert blocks.where("term in ('alpha', 'beta', 'gamma', 'note')").count() <= 8
    assert own.table("terms").agg({"df": "sum"}).head()[0] == len(posted)
    assert {(r.doc_id, r.dl) for r in index.lengths(index.postings(df)).collect()} == {(k, d) for r in own.table("postings").where("bucket = -1").collect() for k, d in zip(r.key, r.dl, strict=True)}


@pytest.mark.parametrize("name", ["index_stored", "bm25_top"])
def test_repeated_and_null_keys_count_as_in_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from skein.plans.queries import QUERIES, SQL

    texts = [(1, "prompt cache and schema schema"), (1, "prompt validator"), (2, "cache"), (None, "stale bridge of many other long words, each once"), (None, "stale cache"), (3, None), (3, "schema keeps"), (4, ""), (5, "stale finder bridge")]
    rows = [(k, t, None, "p") for k, t in texts]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, note_type STRING, path STRING").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == c.execute(SQL[name]).fetchall()
