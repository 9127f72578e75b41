"""Queries of the engine's own operators over the data tables, each with its equivalent in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.jsons import readable
from skein.operators import graph, index, similar, stored, topics
from skein.plans.blocks import last_known
from skein.session import table
from skein.vocab import CONCEPT_PATTERNS, DOMAINS, EVENT_TYPES, NEGATIONS, NOTE_FOLDERS, REPLACING, STOP_WORDS, TOOLS, TOPICS

QUERY = "bridge finder keeps the prompt cache and schema validator stale"
#: The built-in list of tools and names that the test tables hold.
NAMED = [*TOOLS, "kestrelbox", "quillstore", "juncture", "tidewell", "parser", "exporter"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# Sources

_LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT id, title, platform, session_id, updated_at, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, platform DESC NULLS LAST, session_id DESC NULLS LAST) AS rn FROM conversations) WHERE rn = 1"


@query(f"SELECT id, title, platform, session_id, epoch_us(updated_at) AS updated_us FROM ({_LATEST})")
def conversations_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest export of each conversation."""
    own = table(spark, folder, "conversations").select("id", "title", "platform", "session_id", "updated_at")
    last = own.groupBy("id").agg(F.max(F.struct("updated_at", "title", "platform", "session_id")).alias("m"))
    return last.select("id", "m.title", "m.platform", "m.session_id", F.unix_micros("m.updated_at").alias("updated_us"))


_MESSAGES = "(SELECT DISTINCT conversation_id, position, id, role, content, model, tokens FROM messages)"


@query(f"SELECT conversation_id, count(*) AS messages, count_if(lower(trim(role)) IN ('user', 'human')) AS from_user, count_if(lower(trim(role)) IN ('assistant', 'model', 'ai')) AS from_assistant, sum(tokens)::BIGINT AS tokens, sum(len(regexp_extract_all(content, '\\S+')))::BIGINT AS words FROM {_MESSAGES} GROUP BY ALL")
def conversation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Message, role, token and word counts of each conversation."""
    own = topics.deliveries(table(spark, folder, "messages"))
    role = F.lower(F.trim("role"))
    return own.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.count_if(role.isin("user", "human")).alias("from_user"), F.count_if(role.isin("assistant", "model", "ai")).alias("from_assistant"), F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("content").isNotNull(), T.word_count(F.col("content")))).alias("words"),
    )


@query(f"SELECT conversation_id FROM {_MESSAGES} GROUP BY ALL HAVING count(*) >= 2")
def conversations_long_enough(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of at least two messages."""
    return topics.deliveries(table(spark, folder, "messages")).groupBy("conversation_id").agg(F.count("*").alias("n")).where("n >= 2").select("conversation_id")


_JSON = "(SELECT rec_id, session_file, line_no, json(ltrim(line, chr(65279))) AS j FROM (SELECT DISTINCT rec_id, session_file, line_no, line FROM codex_lines) WHERE json_valid(ltrim(line, chr(65279))))"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    get = lambda p: F.try_variant_get("parsed", p, "string")
    own = readable(table(spark, folder, "codex_lines"), "line")
    return own.select("rec_id", "session_file", "line_no", get("$.type").alias("type"), get("$.payload.type").alias("payload_type"), get("$.payload.role").alias("role"), get("$.payload.model").alias("model"), get("$.payload.name").alias("name"), get("$.payload.cwd").alias("cwd"), get("$.payload.id").alias("payload_id")).distinct()


@query(f"SELECT rec_id, line_no, j->>'$.type' AS type, j->>'$.payload.type' AS payload_type, CASE j->>'$.payload.role' WHEN 'developer' THEN 'system' ELSE j->>'$.payload.role' END AS role FROM {_JSON}")
def codex_records(spark: SparkSession, folder: str) -> DataFrame:
    """Readable session lines with their kinds and plain roles."""
    return _lines(spark, folder).select("rec_id", "line_no", "type", "payload_type", F.when(F.col("role") == "developer", "system").otherwise(F.col("role")).alias("role"))


@query(f"SELECT rec_id, line_no, last_value(CASE WHEN j->>'$.type' = 'turn_context' THEN j->>'$.payload.model' END IGNORE NULLS) OVER (PARTITION BY session_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS model FROM {_JSON}")
def codex_model_carried(spark: SparkSession, folder: str) -> DataFrame:
    """The model of the last turn context at or before each session line."""
    own = _lines(spark, folder).select("rec_id", "session_file", "line_no", F.when(F.col("type") == "turn_context", F.col("model")).alias("own"))
    return last_known(own, ["session_file"], "line_no", "own", "model").select("rec_id", "line_no", "model")


@query(f"SELECT session_file, nullif(regexp_extract(j->>'$.payload.cwd', '([^/]+)/*$', 1), '') AS title, array_to_string(regexp_extract_all(lower(j->>'$.payload.id'), '[a-z0-9]+')[1:10], '-') AS slug FROM {_JSON} WHERE j->>'$.type' = 'session_meta'")
def codex_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Session titles from the last part of the working folder, and slugs of their ids."""
    own = _lines(spark, folder).where("type = 'session_meta'")
    return own.select("session_file", F.nullif(F.regexp_extract("cwd", "([^/]+)/*$", 1), F.lit("")).alias("title"), T.slug(F.col("payload_id"), size=1000).alias("slug"))


@query("SELECT rec_id, count(*) AS conversations FROM (SELECT DISTINCT rec_id, payload FROM chatgpt_exports WHERE json_valid(ltrim(payload, chr(65279)))), unnest(CASE WHEN json_type(ltrim(payload, chr(65279))) = 'ARRAY' THEN json_extract(ltrim(payload, chr(65279)), '$[*]') WHEN json_type(ltrim(payload, chr(65279)), '$.conversations') = 'ARRAY' THEN json_extract(ltrim(payload, chr(65279)), '$.conversations[*]') ELSE [json(ltrim(payload, chr(65279)))] END) AS u(c) GROUP BY rec_id")
def chatgpt_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """How many conversations each readable export holds: a list, a 'conversations' list or one object."""
    own = readable(table(spark, folder, "chatgpt_exports"), "payload").select("rec_id", "payload", "parsed")
    listed = F.coalesce(F.try_variant_get("parsed", "$", "array<variant>"), F.try_variant_get("parsed", "$.conversations", "array<variant>"))
    return own.select("rec_id", "payload", F.coalesce(F.size(listed), F.lit(1)).cast("bigint").alias("conversations")).distinct().groupBy("rec_id").agg(F.sum("conversations").alias("conversations")).where("conversations > 0")


@query("SELECT doc_id, regexp_replace(split_part(l, ':', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS key, regexp_replace(substring(l, position(':' IN l) + 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS value FROM (SELECT doc_id, unnest(string_split(substring(text, 4, position(chr(10) || '---' IN substring(text, 4)) - 1), chr(10))) AS l FROM documents WHERE starts_with(text, '---') AND position(chr(10) || '---' IN substring(text, 4)) > 0) WHERE contains(l, ':')")
def note_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Front matter of notes, a row for each key."""
    own = table(spark, folder, "documents").where(F.col("text").startswith("---")).select("doc_id", T.front_matter(F.col("text")).alias("m"))
    return own.select("doc_id", F.explode("m").alias("key", "value"))


# Projections and predicates

_NOTE_CASE = " ".join(f"WHEN list_has_any(string_split(lower(path), '/'), [{quoted(v)}]) THEN '{k}'" for k, v in NOTE_FOLDERS.items())


@query(f"SELECT doc_id, coalesce(nullif(note_type, ''), CASE {_NOTE_CASE} ELSE 'note' END) AS kind FROM documents")
def note_types(spark: SparkSession, folder: str) -> DataFrame:
    """Stated note type, or the one that the path tells."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce(T.note_type(F.col("note_type"), F.col("path")), F.lit("note")).alias("kind"))


_FLAGS = ", ".join(f"regexp_matches(content, '(?i){p.replace(chr(39), chr(39) * 2)}') AS {s}{i}" for i, pair in enumerate(NEGATIONS) for s, p in zip("pn", pair))


# letters of other scripts are made one letter, so that borders of ASCII words are those of all words
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(content, '\\p{Z}', ' ', 'g'), '[^\\x00-\\x7f\\p{L}\\p{N}]', chr(1), 'g'), '[^\\x00-\\x7f]', 'x', 'g')"


@query(f"SELECT DISTINCT id, {_FLAGS} FROM (SELECT id, {_PLAIN} AS content FROM messages WHERE content IS NOT NULL)")
def negation_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Assertion and negation flags of all messages, in whatever script."""
    own = table(spark, folder, "messages").where("content is not null")
    return own.select("id", *T.negation_flags(F.col("content"))).distinct()


def _any_sql(column: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted([k.lower()])})" for k in keywords) + ")"


@query(f"SELECT DISTINCT id FROM messages WHERE {_any_sql('content', REPLACING)}")
def replacing_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that say they replace something."""
    return table(spark, folder, "messages").where(T.replaces(F.col("content"))).select("id").distinct()


_DOMAIN_ROWS = " UNION ALL ".join(f"SELECT '{d}' AS domain, count(*) AS documents FROM documents WHERE {_any_sql('text', ks)} HAVING count(*) > 0" for d, ks in DOMAINS.items())


@query(_DOMAIN_ROWS)
def domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each domain; a document may have several."""
    own = table(spark, folder, "documents").where("text is not null").select(F.explode(T.domains(F.col("text"), DOMAINS)).alias("domain"))
    return own.groupBy("domain").agg(F.count("*").alias("documents"))


def _first_sql(column: str, vocabulary: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(column, ks)} THEN '{d}'" for d, ks in vocabulary.items()) + f" ELSE '{other}' END"


@query(f"SELECT id, max(kind) AS kind FROM (SELECT id, {_first_sql('title', EVENT_TYPES, 'event')} AS kind FROM conversations WHERE title IS NOT NULL) GROUP BY id")
def title_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The first event type that each title's words tell."""
    own = table(spark, folder, "conversations").where("title is not null").select("id", T.first_domain(F.col("title"), EVENT_TYPES, "event").alias("kind"))
    return own.groupBy("id").agg(F.max("kind").alias("kind"))


@query("SELECT doc_id, sha256(text) AS hash, substring(regexp_replace(path, '[<>:\"/\\\\|?*]', '', 'g'), 1, 200) AS file FROM documents")
def note_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Content hashes and file names of notes."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), T.file_name(F.col("path")).alias("file"))


# Index and retrieval

_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND x NOT IN ({quoted(STOP_WORDS)}))"
_TF = f"tk AS (SELECT doc_id, {_TOKENS} AS ts FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS n, count(*) / max(total)::DOUBLE AS tf FROM (SELECT doc_id, len(ts) AS total, unnest(ts) AS term FROM tk) GROUP BY doc_id, term)"
_N = "(SELECT count(*) FROM documents)"
_IDF = f"{_TF}, idf AS (SELECT term, count(*) AS df, ln((1 + {_N}) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term)"


def _posted(spark: SparkSession, folder: str) -> DataFrame:
    return index.postings(table(spark, folder, "documents"))


@query(f"WITH {_TF} SELECT doc_id, term, n, round(tf, 6) AS tf FROM tf")
def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Term frequencies of all documents."""
    return _posted(spark, folder).select("doc_id", "term", "n", F.round("tf", 6).alias("tf"))


@query(f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies of all terms."""
    return index.inverse_frequency(_posted(spark, folder), table(spark, folder, "documents").count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TF} SELECT doc_id, CAST(round_even(1 / min(tf), 0) AS BIGINT) AS dl FROM tf GROUP BY doc_id")
def index_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of documents as the index keeps them."""
    return index.lengths(_posted(spark, folder))


_TERMS = index.query_terms(QUERY)
_Q = "q AS (SELECT unnest([" + quoted(_TERMS) + "]) AS term)"
_BM25 = f"{_IDF}, {_Q}, dl AS (SELECT doc_id, round_even(1 / min(tf), 0) AS dl FROM tf GROUP BY doc_id), av AS (SELECT avg(dl) AS a FROM dl), bm AS (SELECT tf.doc_id, sum(idf.idf * (tf.tf * dl.dl) * 2.5 / (tf.tf * dl.dl + 1.5 * (0.25 + 0.75 * dl.dl / av.a))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, av GROUP BY tf.doc_id)"


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents by BM25."""
    scored = stored.kept_index(table(spark, folder, "documents")).bm25(QUERY)
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_IDF}, {_Q}, qc AS (SELECT term, count(*) / {float(len(_TERMS))} AS tf FROM q GROUP BY term), qn AS (SELECT sqrt(sum((qc.tf * idf.idf) ** 2)) AS n FROM qc JOIN idf USING (term)), nm AS (SELECT doc_id, sqrt(sum((tf.tf * idf.idf) ** 2)) AS n FROM tf JOIN idf USING (term) GROUP BY doc_id), dt AS (SELECT doc_id, sum(tf.tf * idf.idf * qc.tf * idf.idf) AS d FROM tf JOIN idf USING (term) JOIN qc USING (term) GROUP BY doc_id) SELECT doc_id, round(d / (nm.n * qn.n), 6) AS score FROM dt JOIN nm USING (doc_id), qn ORDER BY round(d / (nm.n * qn.n), 9) DESC, doc_id LIMIT 10")
def tfidf_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents by the cosine of tf-idf vectors."""
    scored = stored.kept_index(table(spark, folder, "documents")).cosine(QUERY)
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


_META = "SELECT doc_id, map_from_entries(list_transform(list_filter(string_split(CASE WHEN starts_with(text, '---') AND position(chr(10) || '---' IN substring(text, 4)) > 0 THEN substring(text, 4, position(chr(10) || '---' IN substring(text, 4)) - 1) ELSE '' END, chr(10)), lambda l: contains(l, ':')), lambda l: struct_pack(k := trim(split_part(l, ':', 1)), v := trim(substring(l, position(':' IN l) + 1))))) AS m FROM documents"
_FIELDS = f"fields AS (SELECT doc_id, coalesce(nullif(m['type'], ''), nullif(note_type, ''), CASE {_NOTE_CASE} ELSE 'note' END) AS kind, coalesce(m['domain'], m['category'], '') AS domain, coalesce(m['tags'], '') AS tags FROM documents JOIN ({_META}) USING (doc_id))"


@query(f"WITH {_FIELDS} SELECT doc_id, kind, domain, tags FROM fields")
def note_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What searches filter on."""
    return stored.note_fields(table(spark, folder, "documents")).select("doc_id", "kind", "domain", "tags")


@query(f"WITH {_BM25}, {_FIELDS} SELECT doc_id, round(score, 6) AS score FROM bm JOIN fields USING (doc_id) WHERE contains(lower(kind), 'decis') AND contains(lower(tags), 'design') ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best decisions with a tag by BM25: filters come before scoring."""
    scored = stored.kept_index(table(spark, folder, "documents")).bm25(QUERY, kind="Decis", tags="DESIGN")
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_IDF} SELECT sum(df)::BIGINT AS postings, count(*) AS terms, {_N} AS documents FROM idf")
def index_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Postings, terms and documents of the stored index."""
    own = stored.kept_index(table(spark, folder, "documents"))
    terms = own.table("terms").agg(F.sum("df").alias("postings"), F.count("*").alias("terms"))
    return terms.join(own.table("stats").select(F.col("n_docs").cast("bigint").alias("documents")))


_NEAR = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS similarity FROM embeddings"


def _vector(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").groupBy().agg(F.min_by("embedding", "vec_id").alias("q"))


@query(f"SELECT vec_id, round(similarity, 5) AS similarity FROM ({_NEAR}) ORDER BY round(similarity, 9) DESC, vec_id LIMIT 30")
def vector_top(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty vectors nearest to the first one, exactly."""
    return index.nearest(table(spark, folder, "embeddings"), _vector(spark, folder), 30).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("SELECT query, vec_id, rank, round(s, 5) AS similarity FROM (SELECT query, vec_id, s, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE s IS NOT NULL) WHERE rank <= 30")
def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty vectors nearest to each one whose number is divisible by 20, among all, exactly."""
    own = table(spark, folder, "embeddings")
    return index.nearest_each(own, own.where("vec_id % 20 = 0"), 30).select("query", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {_BM25}, v AS (SELECT vec_id AS doc_id, 1 / (2 - similarity) AS close FROM ({_NEAR}) ORDER BY round(similarity, 9) DESC, vec_id LIMIT 30), f AS (SELECT coalesce(bm.doc_id, v.doc_id) AS doc_id, coalesce(score / (SELECT max(score) FROM bm), 0) * 0.7 + coalesce(close / (SELECT max(close) FROM v), 0) * 0.3 AS s FROM bm FULL JOIN v ON bm.doc_id = v.doc_id) SELECT doc_id, round(s, 5) AS score FROM f ORDER BY round(s, 8) DESC, doc_id LIMIT 10")
def hybrid_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents by lexical and vector scores together; a vector belongs to the document of its number."""
    lexical = stored.kept_index(table(spark, folder, "documents")).bm25(QUERY)
    near = index.nearest(table(spark, folder, "embeddings"), _vector(spark, folder), 30).withColumnRenamed("vec_id", "doc_id")
    return index.fuse(lexical, near, 10).select("doc_id", F.round("score", 5).alias("score"))


@query("SELECT path FROM documents n WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.updated_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' AND o.path = n.path AND sha256(o.text) = sha256(n.text))")
def notes_to_index(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that an index of the notes before 2025 doesn't hold."""
    notes = table(spark, folder, "documents")
    held = notes.where(F.col("updated_at") < F.lit("2025-01-01T00:00:00Z").cast("timestamp")).select("path", F.sha2("text", 256).alias("content_hash"))
    return index.to_index(notes.select("path", "text"), held).select("path")


# Topics and concepts

_SPACED = "'  ' || array_to_string(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), '  ') || '  '"


def _phrase_sql(phrase: str) -> str:
    sought = " " + "  ".join(phrase.replace("/", " ").split()) + " "
    return f"(length(t) - length(replace(t, '{sought}', ''))) // {len(sought)}"


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT conversation_id, '{k}' AS topic, {i} AS ord, sum({' + '.join(map(_phrase_sql, ks))})::BIGINT AS hits, sum(n) AS n FROM m GROUP BY conversation_id" for i, (k, ks) in enumerate(TOPICS.items()))
_TOPICS = f"m AS (SELECT conversation_id, len(regexp_extract_all(content, '\\S+')) AS n, {_SPACED} AS t FROM {_MESSAGES} WHERE content IS NOT NULL), ts AS (SELECT conversation_id, topic, ord, hits, hits / n::DOUBLE AS score FROM ({_TOPIC_ROWS}) WHERE hits > 0 AND n > 0)"


@query(f"WITH {_TOPICS} SELECT conversation_id, topic, hits, round(score, 6) AS score FROM ts")
def topic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword scores of conversations by topic."""
    own = topics.topic_scores(topics.deliveries(table(spark, folder, "messages")))
    return own.select("conversation_id", "topic", "hits", F.round("score", 6).alias("score"))


@query(f"WITH {_TOPICS} SELECT conversation_id, rank, topic, round(least(top * 100, 1.0), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, ord)::INTEGER AS rank, max(score) OVER (PARTITION BY conversation_id) AS top FROM ts) WHERE rank <= 5")
def topic_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The five best topics of each conversation."""
    own = topics.topics_of(topics.topic_scores(topics.deliveries(table(spark, folder, "messages"))))
    return own.select("conversation_id", "rank", "topic", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT DISTINCT conversation_id, unnest(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')), [{quoted(NAMED)}])) AS tool FROM messages WHERE content IS NOT NULL")
def tools_named(spark: SparkSession, folder: str) -> DataFrame:
    """Things of a list named in each conversation."""
    return topics.tools_in(table(spark, folder, "messages"), NAMED)


_KINDS = list(dict.fromkeys(k for k, _ in CONCEPT_PATTERNS))
_FOUND = " UNION ALL ".join(
    f"SELECT conversation_id, pos, id, {_KINDS.index(k)} AS k, {i} AS p, j, trim(c) AS content FROM (SELECT conversation_id, pos, id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS j FROM (SELECT *, regexp_extract_all(t, '(?i){p.replace(chr(39), chr(39) * 2)}', 1) AS cs FROM rows_))" for i, (k, p) in enumerate(CONCEPT_PATTERNS)
)
_CONCEPTS = f"rows_ AS (SELECT conversation_id, coalesce(position, -1) AS pos, id, regexp_replace(content, '\\n+$', '') AS t FROM {_MESSAGES} WHERE content IS NOT NULL), each_ AS (SELECT * FROM ({_FOUND}) WHERE length(content) BETWEEN 10 AND 500), first_ AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, k, lower(content) ORDER BY p, pos, id, j, content) AS f FROM each_), ranked AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY k, p, pos, id, j, content)::INTEGER AS rank FROM first_ WHERE f = 1)"


@query(f"WITH {_CONCEPTS} SELECT conversation_id, CASE k {' '.join(f'WHEN {i} THEN {quoted([k])}' for i, k in enumerate(_KINDS))} END AS concept_type, content, rank FROM ranked WHERE rank <= 200")
def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Action items, decisions, questions and insights of conversations, at most two hundred each."""
    return topics.concepts(topics.deliveries(table(spark, folder, "messages"))).select("conversation_id", "concept_type", "content", "rank")


# Entities and links


@query("SELECT conversation_id, id, (count(*) OVER (PARTITION BY conversation_id) - 1)::BIGINT AS links FROM (SELECT DISTINCT conversation_id, id FROM entities WHERE conversation_id IS NOT NULL AND id IS NOT NULL)")
def entity_co_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """How many entities each one shares its conversation with."""
    return graph.co_occurrence(table(spark, folder, "entities"))


@query("SELECT topic, id, min(id) OVER (PARTITION BY topic) AS first_id, (count(*) OVER (PARTITION BY topic) - 1)::BIGINT AS links FROM (SELECT DISTINCT id, unnest(topics) AS topic FROM conversations WHERE id IS NOT NULL) WHERE topic IS NOT NULL")
def conversation_topic_links(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations linked by shared topics, by class and number of links."""
    return graph.topic_links(table(spark, folder, "conversations"))


_CANONICAL = "own AS (SELECT id, lower(name) AS n, entity_type AS t, row_number() OVER (PARTITION BY lower(name) ORDER BY coalesce(conversation_id, ''), coalesce(ord, -1), id, entity_type NULLS FIRST) AS rn FROM entities WHERE name IS NOT NULL AND id IS NOT NULL), canonical AS (SELECT o.id, min(CASE WHEN o.t = f.t THEN f.id ELSE o.id END) AS canonical_id FROM own o JOIN own f ON o.n = f.n AND f.rn = 1 GROUP BY o.id)"


@query(f"WITH {_CANONICAL} SELECT id, canonical_id FROM canonical")
def entities_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Entities merged by equal name."""
    return graph.canonical_by_name(table(spark, folder, "entities"))


@query(f"WITH {_CANONICAL} SELECT canonical_id, count(DISTINCT id) AS members, epoch_us(min(first_seen)) AS first_us, epoch_us(max(last_seen)) AS last_us FROM entities JOIN canonical USING (id) GROUP BY canonical_id")
def entities_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Members and times of merged entities."""
    own = table(spark, folder, "entities")
    merged = graph.merged_entities(own, graph.canonical_by_name(own))
    return merged.select("canonical_id", "members", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(f"WITH {_CANONICAL}, names AS (SELECT DISTINCT canonical_id, unnest(list_concat([name], coalesce(aliases, []))) AS alias FROM entities JOIN canonical USING (id)), main AS (SELECT id, min(name) AS name FROM entities WHERE name IS NOT NULL GROUP BY id) SELECT canonical_id, alias FROM names LEFT JOIN main ON main.id = canonical_id WHERE alias IS NOT NULL AND (name IS NULL OR alias <> name)")
def entity_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Other names of merged entities."""
    own = table(spark, folder, "entities")
    return graph.merged_aliases(own, graph.canonical_by_name(own))


@query(f"WITH {_CANONICAL} SELECT e.conversation_id AS source_id, coalesce(c.canonical_id, e.id) AS target_id, count(*) AS edges FROM entities e LEFT JOIN canonical c ON c.id = e.id WHERE e.conversation_id IS NOT NULL AND e.conversation_id <> coalesce(c.canonical_id, e.id) GROUP BY ALL")
def mention_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation to entity edges after merging; parallel edges are counted."""
    own = table(spark, folder, "entities")
    edges = own.where("conversation_id is not null").select(F.col("conversation_id").alias("source_id"), F.col("id").alias("target_id"))
    return graph.remap(edges, graph.canonical_by_name(own)).groupBy("source_id", "target_id").agg(F.count("*").alias("edges"))


@query("SELECT DISTINCT a AS node, b AS neighbour FROM (SELECT lower(trim(subject)) AS a, lower(trim(object)) AS b FROM extracted_relationships UNION ALL SELECT lower(trim(object)), lower(trim(subject)) FROM extracted_relationships) WHERE a IS NOT NULL AND b IS NOT NULL")
def related_names(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected neighbours of each name."""
    own = table(spark, folder, "extracted_relationships").select(F.lower(F.trim("subject")).alias("a"), F.lower(F.trim("object")).alias("b"))
    return graph.neighbours(own, "a", "b")


@query(f"WITH {_CONCEPTS}, c AS (SELECT DISTINCT content FROM ranked WHERE rank <= 200), n AS (SELECT DISTINCT lower(name) AS name FROM name_lexicon WHERE trim(name) <> '') SELECT DISTINCT content, name FROM c JOIN n ON contains(lower(content), name)")
def concept_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the lexicon held by concepts."""
    own = topics.concepts(topics.deliveries(table(spark, folder, "messages"))).select("content").distinct()
    return graph.mentions(own, "content", "content", table(spark, folder, "name_lexicon"))


@query()
def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts and all entities whose name they hold; concept_mentions has the names of the lexicon only."""
    found = topics.concepts(topics.deliveries(table(spark, folder, "messages")))
    own = found.select(T.short_id(F.col("conversation_id"), F.col("concept_type"), F.lower("content")).alias("id"), "content")
    return graph.entity_mentions(own, table(spark, folder, "entities"))


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, 'conversation' AS kind FROM conversations UNION ALL SELECT DISTINCT id, 'entity:' || lower(entity_type) FROM entities WHERE entity_type IS NOT NULL UNION ALL SELECT DISTINCT id, 'extracted:' || lower(entity_type) FROM extracted_entities WHERE entity_type IS NOT NULL) GROUP BY kind")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the graph by kind."""
    parts = [table(spark, folder, "conversations").select("id", F.lit("conversation").alias("kind"))]
    parts += [table(spark, folder, t).where("entity_type is not null").select("id", F.concat(F.lit(f"{k}:"), F.lower("entity_type")).alias("kind")) for t, k in (("entities", "entity"), ("extracted_entities", "extracted"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return whole.groupBy("kind").agg(F.count("*").alias("n"))


# Curation

_SCORES = (
    f"WITH {_CONCEPTS}, c AS (SELECT DISTINCT conversation_id FROM ranked WHERE rank <= 200 AND k IN (0, 1)), "
    f"m AS (SELECT conversation_id, count(*) AS n, sum(coalesce(len(regexp_extract_all(content, '\\S+')), 0)) AS w, max(CASE WHEN model IS NOT NULL THEN 1.0 ELSE 0.0 END) AS model, CASE WHEN count(stamp) >= 2 THEN (epoch_us(max(stamp)) - epoch_us(min(stamp))) / 1000000.0 END AS d FROM (SELECT conversation_id, id, content, model, min(ingested_at) AS stamp FROM messages GROUP BY conversation_id, id, content, model) GROUP BY conversation_id), "
    "t AS (SELECT id AS conversation_id, max(coalesce(len(topics), 0)) AS topics FROM conversations WHERE id IS NOT NULL GROUP BY id), "
    "s AS (SELECT m.conversation_id, greatest(0.0, least(1.0, 0.2 * least(n / 30.0, 1) + 0.2 * least(w / 6000.0, 1) + 0.15 * least(w / n / 200.0, 1) + 0.1 * model + 0.1 * least(coalesce(d, 0) / 7200.0, 1) + 0.1 * least(coalesce(topics, 0) / 5.0, 1) + 0.15 * (CASE WHEN c.conversation_id IS NULL THEN 0 ELSE 1 END))) AS score FROM m LEFT JOIN t USING (conversation_id) LEFT JOIN c USING (conversation_id))"
)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "messages")
    own = messages.groupBy("conversation_id", "id", "content", "model").agg(F.min("ingested_at").alias("at"))
    return graph.source_scores(own, table(spark, folder, "conversations"), topics.concepts(topics.deliveries(messages)), "at")


@query(f"{_SCORES} SELECT conversation_id, round(score, 9) AS score FROM s")
def source_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of conversations."""
    return _scores(spark, folder).select("conversation_id", F.round("score", 9).alias("score"))


@query(f"{_SCORES} SELECT least(4, greatest(0, floor(round(score, 9) * 5)))::INTEGER AS bin, count(*) AS n FROM s GROUP BY bin")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of the quality scores."""
    return graph.histogram(_scores(spark, folder).withColumn("score", F.round("score", 9)), "score")


@query("SELECT 0.5::DOUBLE AS point, quantile_disc(round(confidence, 4), 0.5) AS value FROM extracted_entities UNION ALL SELECT 0.9::DOUBLE, quantile_disc(round(confidence, 4), 0.9) FROM extracted_entities UNION ALL SELECT 0.95::DOUBLE, quantile_disc(round(confidence, 4), 0.95) FROM extracted_entities")
def confidence_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the confidence of extracted entities."""
    return graph.percentiles(table(spark, folder, "extracted_entities"), "confidence", [0.5, 0.9, 0.95])


@query()
def superseded_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions and action items that a later one replaces, in the order of their conversations' latest export."""
    found = topics.concepts(topics.deliveries(table(spark, folder, "messages"))).where("concept_type in ('decision', 'action_item')")
    dates = table(spark, folder, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.unix_micros(F.max("updated_at")).alias("at"))
    own = found.join(dates, "conversation_id", "left").select(T.short_id(F.col("conversation_id"), F.col("concept_type"), F.lower("content")).alias("id"), F.col("concept_type").alias("type"), F.col("content").alias("text"), "at")
    return similar.superseded(own)


@query()
def contradictory_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions and insights of different conversations that contradict each other, by a ratio of a half."""
    found = topics.concepts(topics.deliveries(table(spark, folder, "messages"))).where("concept_type in ('decision', 'insight')")
    dates = table(spark, folder, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.unix_micros(F.max("updated_at")).alias("at"))
    id_ = T.short_id(F.col("conversation_id"), F.col("concept_type"), F.lower("content"))
    own = found.join(dates, "conversation_id", "left").select(id_.alias("id"), F.col("concept_type").alias("type"), F.col("content").alias("text"), "at", F.col("conversation_id").alias("group"))
    return similar.contradictions(own)


# Events as calendar days and sessions


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their values by day and type."""
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, count(*) AS events, CASE WHEN count(ts) >= 2 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE END AS seconds, min(CASE WHEN ts = first THEN event_type END) AS first_type FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY user_id")
def user_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds between a user's first and last event, and the first event's type."""
    own = table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.when(F.count("ts") >= 2, (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).alias("seconds"), F.min(F.struct("ts", "event_type")).alias("f")
    )
    return own.select("user_id", "events", "seconds", F.col("f.event_type").alias("first_type"))


@query("SELECT event_type, sum(try_cast(props->>'$.k' AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of a number held in the events' JSON properties."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("total"))
