"""Queries of the projections that curation, exports and indexes are made of, each with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import curation as C
from skein.operators import graph, topics
from skein.plans import queries as own_queries
from skein.plans.queries import _CANONICAL, _CONCEPTS, _JSON, _KINDS, _META, _SCORES, _any_sql, _first_sql, _lines, _scores, quoted
from skein.session import table
from skein.vocab import AGENTS, CARD_FRONTS, DECKS, DOMAINS, ENTITY_TYPES, PLATFORM_AUTHORS, PLATFORM_INGESTERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _case(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return topics.concepts(topics.deliveries(table(spark, folder, "messages")))


_TYPE = f"CASE k {' '.join(f'WHEN {i} THEN {quoted([k])}' for i, k in enumerate(_KINDS))} END"
_OWN = f"{_CONCEPTS}, c AS (SELECT conversation_id, {_TYPE} AS concept_type, content, rank FROM ranked WHERE rank <= 200)"
_VALID = quoted(AGENTS)

# Conversations and their sources


@query(f"SELECT DISTINCT id, coalesce(CASE WHEN author IN ({_VALID}) THEN author END, {_case(PLATFORM_AUTHORS, 'platform')}) AS author, coalesce(CASE WHEN ingested_by IN ({_VALID}) THEN ingested_by END, {_case(PLATFORM_INGESTERS, 'platform')}) AS ingester, coalesce(nullif(session_id, ''), nullif(session_slug, ''), id) AS session FROM conversations")
def conversation_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Author, ingester and session of each exported header."""
    return C.provenance(table(spark, folder, "conversations"))


@query("SELECT platform, count(DISTINCT conversation_id) AS conversations, count(*) AS messages, sum(coalesce(strlen(content), 0))::BIGINT AS bytes FROM (SELECT DISTINCT platform, conversation_id, id, content FROM messages) GROUP BY platform")
def export_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations, messages and bytes of each platform."""
    own = table(spark, folder, "messages").select("platform", "conversation_id", "id", "content").distinct()
    return own.groupBy("platform").agg(F.count_distinct("conversation_id").alias("conversations"), F.count("*").alias("messages"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).cast("bigint").alias("bytes"))


_FIRST = "json_extract(j, '$[0]')"
_PLATFORM = f"CASE WHEN json_type(j) = 'ARRAY' THEN CASE WHEN json_exists({_FIRST}, '$.mapping') THEN 'chatgpt' WHEN json_exists({_FIRST}, '$.chat_messages') THEN 'claude' WHEN json_exists({_FIRST}, '$.entries') THEN 'gemini' END WHEN json_exists(j, '$.chat_messages') THEN 'claude' WHEN json_exists(j, '$.mapping') THEN 'chatgpt' WHEN json_exists(j, '$.entries') THEN 'gemini' END"


@query(f"SELECT {_PLATFORM} AS platform, count(*) AS exports FROM (SELECT DISTINCT rec_id, json(ltrim(payload, chr(65279))) AS j FROM chatgpt_exports WHERE json_valid(ltrim(payload, chr(65279)))) GROUP BY 1")
def export_platforms(spark: SparkSession, folder: str) -> DataFrame:
    """Exports by the platform that their keys tell."""
    own = C.platform_of(table(spark, folder, "chatgpt_exports").select("rec_id", "payload").distinct())
    return own.groupBy("platform").agg(F.count("*").alias("exports"))


@query(f"SELECT session_file, 'codex-' || array_to_string(regexp_extract_all(lower(j->>'$.payload.id'), '[a-z0-9]+')[1:10], '-') || '-' || strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d-%H%M%S') AS author FROM {_JSON} JOIN (SELECT session_file AS s, min(received_at)::TIMESTAMPTZ AS seen FROM codex_lines GROUP BY 1) ON s = session_file WHERE j->>'$.type' = 'session_meta'")
def codex_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Authors of agent sessions, from the slug of their id and when they arrived first."""
    meta = _lines(spark, folder).where("type = 'session_meta'").select("session_file", T.slug(F.col("payload_id"), size=1000).alias("slug"))
    first = table(spark, folder, "codex_lines").groupBy("session_file").agg(F.min("received_at").cast("timestamp").alias("at"))
    return meta.join(first, "session_file").select("session_file", F.concat(F.lit("codex-"), "slug", F.lit("-"), F.date_format("at", "yyyy-MM-dd-HHmmss")).alias("author"))


# Events as a calendar


@query("SELECT CAST(ts AS DATE) AS day, 'calendar-' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS id, count(*) AS events, count(DISTINCT user_id) AS people, epoch_us(min(ts)) AS first_us, any_value(types) AS types FROM events JOIN (SELECT day, array_to_string(list(event_type ORDER BY t, e), ',') AS types FROM (SELECT CAST(ts AS DATE) AS day, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL) GROUP BY day) d ON d.day = CAST(ts AS DATE) GROUP BY ALL")
def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's events as one conversation, with its types in the order they first come."""
    return C.event_days(table(spark, folder, "events"))


@query("SELECT event_id, substring(md5(event_id || ':' || strftime(ts, '%Y-%m-%d')), 1, 12) AS message_id FROM events")
def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Stable ids of the messages that events become."""
    return table(spark, folder, "events").select("event_id", F.substring(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))), 1, 12).alias("message_id"))


_ITEM = "(?i)(?:[-*•]\\s*(?:TODO|Action item|Task|Follow-?up)[:\\s]+(.+)|Action items?:\\s*(.+?)(?:\\n|$)|[-*•]\\s*\\[\\s*\\]\\s*(.+))"


@query(f"SELECT DISTINCT id, item FROM (SELECT id, unnest(list_transform(list_zip(regexp_extract_all(t, '{_ITEM}', 1), regexp_extract_all(t, '{_ITEM}', 2), regexp_extract_all(t, '{_ITEM}', 3)), lambda z: regexp_replace(coalesce(z[1], '') || coalesce(z[2], '') || coalesce(z[3], ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))) AS item FROM (SELECT doc_id AS id, regexp_replace(text, '\\n+$', '') AS t FROM documents WHERE text IS NOT NULL)) WHERE item <> ''")
def note_action_items(spark: SparkSession, folder: str) -> DataFrame:
    """Action items that notes list."""
    own = table(spark, folder, "documents").where("text is not null")
    return own.select(F.col("doc_id").alias("id"), F.explode(C.action_items(F.regexp_replace("text", r"\n+$", ""))).alias("item")).distinct()


@query("SELECT doc_id, regexp_extract(text, '[*][*](.+?)[*][*]', 1) AS title FROM documents WHERE contains(text, '**')")
def bold_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The first bold words of notes as their titles."""
    own = table(spark, folder, "documents").where(F.contains("text", F.lit("**")))
    return own.select("doc_id", F.regexp_extract("text", "(?d)[*][*](.+?)[*][*]", 1).alias("title"))


# Concepts


@query(f"WITH {_OWN} SELECT conversation_id, concept_type, content FROM c WHERE concept_type IN ('action_item', 'decision')")
def actionable_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts that call for something."""
    return _found(spark, folder).where(C.actionable(F.col("concept_type"))).select("conversation_id", "concept_type", "content")


@query(f"WITH {_OWN} SELECT concept_type, CASE concept_type WHEN 'action_item' THEN 'procedural' ELSE 'semantic' END AS memory_type, count(*) AS n, count(*) <= 20 AS listed FROM c GROUP BY ALL")
def concept_index(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts by type, with their kind of memory, and whether they are few enough to be listed one by one."""
    own = _found(spark, folder).groupBy("concept_type", C.memory_type(F.col("concept_type")).alias("memory_type")).agg(F.count("*").alias("n"))
    return own.withColumn("listed", F.col("n") <= 20)


_CONCEPT_ID = "substring(sha256(conversation_id || chr(31) || concept_type || chr(31) || lower(content)), 1, 12)"


@query(f"WITH {_OWN} SELECT DISTINCT conversation_id AS source_id, {_CONCEPT_ID} AS target_id FROM c WHERE conversation_id IS NOT NULL")
def concept_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from conversations to their concepts."""
    id_ = T.short_id(F.col("conversation_id"), F.col("concept_type"), F.lower("content"))
    return _found(spark, folder).where("conversation_id is not null").select(F.col("conversation_id").alias("source_id"), id_.alias("target_id")).distinct()


@query(f"WITH {_OWN}, h AS (SELECT id, max(platform) AS platform, max(session_id) AS session_id, max(model_id) AS model_id FROM conversations GROUP BY id) SELECT conversation_id, concept_type, content, platform, session_id, model_id FROM c LEFT JOIN h ON id = conversation_id")
def concept_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts with platform, session and model of the conversation they come from."""
    heads = table(spark, folder, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(*(F.max(c).alias(c) for c in ("platform", "session_id", "model_id")))
    return _found(spark, folder).join(heads, "conversation_id", "left").select("conversation_id", "concept_type", "content", "platform", "session_id", "model_id")


_FRONT = "CASE concept_type WHEN 'question' THEN content " + " ".join(f"WHEN '{k}' THEN '{w}' || regexp_replace(substring(content, 1, 60), '[.,;]+$', '') || '?'" for k, w in CARD_FRONTS.items()) + " END"
_BACK = "CASE concept_type WHEN 'question' THEN '' ELSE content END"


@query(f"WITH {_OWN} SELECT conversation_id, concept_type, {_FRONT} AS front, {_BACK} AS back, substring(sha256({_FRONT} || chr(9) || {_BACK}), 1, 16) AS card_hash FROM c")
def concept_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Fronts, backs and hashes of concepts as cards."""
    return C.cards(_found(spark, folder)).select("conversation_id", "concept_type", "front", "back", "card_hash")


# Entities


@query("SELECT DISTINCT id, name FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM entities WHERE id IS NOT NULL) WHERE name IS NOT NULL")
def entity_names(spark: SparkSession, folder: str) -> DataFrame:
    """All names of each entity."""
    return C.all_names(table(spark, folder, "entities"))


@query("WITH n AS (SELECT DISTINCT id, lower(name) AS name FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM entities WHERE id IS NOT NULL) WHERE name IS NOT NULL) SELECT DISTINCT n.id FROM n JOIN extracted_entities x ON n.name = lower(x.name)")
def entities_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of which a name or alias is the name of a model's entity, without regard to case."""
    names = C.all_names(table(spark, folder, "entities")).select("id", F.lower("name").alias("name"))
    return names.join(table(spark, folder, "extracted_entities").select(F.lower("name").alias("name")).distinct(), "name", "left_semi").select("id").distinct()


_PLACE = "struct_pack(c := coalesce(conversation_id, ''), o := coalesce(ord, -1), id := id)"
_ANY = f"own AS (SELECT id, t, place, lower(name) AS n FROM (SELECT id, entity_type AS t, {_PLACE} AS place, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM entities WHERE id IS NOT NULL) WHERE name IS NOT NULL), f AS (SELECT n, place, t FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY place, t NULLS FIRST) AS rn FROM own) WHERE rn = 1)"


@query(f"WITH {_ANY} SELECT id, (min(CASE WHEN own.t = f.t THEN f.place ELSE own.place END)).id AS canonical_id FROM own JOIN f USING (n) GROUP BY own.id")
def entities_by_any_name(spark: SparkSession, folder: str) -> DataFrame:
    """Entities merged by equal names or aliases."""
    return C.canonical_by_any_name(table(spark, folder, "entities"))


@query(f"WITH {_CANONICAL} SELECT canonical_id, key, value FROM (SELECT canonical_id, key, p->>('$.' || key) AS value, row_number() OVER (PARTITION BY canonical_id, key ORDER BY c DESC, o DESC, id DESC, p->>('$.' || key) DESC) AS rn FROM (SELECT canonical_id, coalesce(conversation_id, '') AS c, coalesce(ord, -1) AS o, e.id, json(properties) AS p, unnest(json_keys(properties)) AS key FROM entities e JOIN canonical USING (id) WHERE json_valid(properties))) WHERE rn = 1")
def entity_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of merged entities; the last entity's value counts."""
    own = table(spark, folder, "entities")
    return C.merged_properties(own, graph.canonical_by_name(own))


@query(f"WITH {_CANONICAL} SELECT DISTINCT canonical_id, conversation_id FROM (SELECT canonical_id, unnest(source_conversations) AS conversation_id FROM entities JOIN canonical USING (id)) WHERE conversation_id IS NOT NULL")
def entity_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that merged entities come from."""
    own = table(spark, folder, "entities")
    return C.merged_sources(own, graph.canonical_by_name(own))


@query(f"WITH {_CANONICAL} SELECT entity_type, count(DISTINCT id) AS entities, count(DISTINCT CASE WHEN id <> canonical_id THEN id END) AS merged FROM entities JOIN canonical USING (id) GROUP BY entity_type")
def merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many entities of each type merge into another one."""
    own = table(spark, folder, "entities")
    whole = own.select("id", "entity_type").join(graph.canonical_by_name(own), "id")
    return whole.groupBy("entity_type").agg(F.count_distinct("id").alias("entities"), F.count_distinct(F.when(F.col("id") != F.col("canonical_id"), F.col("id"))).alias("merged"))


@query("SELECT canonical_id, count(DISTINCT merged_id) AS merged FROM merge_map WHERE canonical_id IN (SELECT id FROM entities) GROUP BY canonical_id")
def merge_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Entities still there that others were merged into."""
    held = table(spark, folder, "entities").select(F.col("id").alias("canonical_id"))
    return table(spark, folder, "merge_map").join(held, "canonical_id", "left_semi").groupBy("canonical_id").agg(F.count_distinct("merged_id").alias("merged"))


@query("SELECT entity_type, name, count(DISTINCT id) AS entities FROM entities WHERE name IS NOT NULL GROUP BY entity_type, name")
def entity_index(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by type and name."""
    return table(spark, folder, "entities").where("name is not null").groupBy("entity_type", "name").agg(F.count_distinct("id").alias("entities")).orderBy("entity_type", "name")


@query(f"SELECT DISTINCT id, name, CASE WHEN lower(entity_type) IN ({quoted(ENTITY_TYPES)}) THEN lower(entity_type) ELSE 'tool' END AS entity_type, coalesce(confidence >= 0.8, false) AS sure FROM extracted_entities")
def model_entities(spark: SparkSession, folder: str) -> DataFrame:
    """A model's entities with plain types, and whether it is sure of them."""
    return C.model_entities(table(spark, folder, "extracted_entities")).select("id", "name", "entity_type", F.coalesce(F.col("confidence") >= 0.8, F.lit(False)).alias("sure")).distinct()


@query("SELECT DISTINCT id, subject AS source_id, object AS target_id, 'relates_to' AS relationship_type, confidence AS weight, evidence, conversation_id AS source_conversation_id FROM extracted_relationships")
def model_relations(spark: SparkSession, folder: str) -> DataFrame:
    """A model's relations as edges."""
    return C.model_relations(table(spark, folder, "extracted_relationships"))


_PAIRED = "(n * (n - 1) // 2)"


@query(
    f"WITH {_OWN} SELECT 'mentions' AS kind, 1.0::DOUBLE AS weight, count(*) AS edges FROM (SELECT DISTINCT conversation_id, id FROM entities WHERE conversation_id IS NOT NULL AND id IS NOT NULL) "
    f"UNION ALL SELECT 'concepts', 1.0::DOUBLE, count(*) FROM (SELECT DISTINCT conversation_id, concept_type, lower(content) FROM c WHERE conversation_id IS NOT NULL) "
    f"UNION ALL SELECT 'co_occurrence', 0.5::DOUBLE, sum({_PAIRED})::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM entities WHERE conversation_id IS NOT NULL AND id IS NOT NULL GROUP BY conversation_id) "
    f"UNION ALL SELECT 'topics', 0.3::DOUBLE, sum({_PAIRED})::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM (SELECT id, unnest(topics) AS topic FROM conversations WHERE id IS NOT NULL) WHERE topic IS NOT NULL GROUP BY topic)"
)
def edge_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of every producer, by kind and weight; pairs of a class are counted, not written out."""
    entities, conversations = table(spark, folder, "entities"), table(spark, folder, "conversations")
    total = lambda df, kind, weight: df.select(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"))
    pairs = lambda df: df.agg(F.sum(F.col("links")).alias("ends")).select((F.col("ends") / 2).alias("edges"))
    members = entities.where("conversation_id is not null and id is not null").select("conversation_id", "id").distinct().agg(F.count("*").alias("edges"))
    held = QUERIES["concept_edges"](spark, folder).agg(F.count("*").alias("edges"))
    parts = [total(members, "mentions", 1.0), total(held, "concepts", 1.0), total(pairs(graph.co_occurrence(entities)), "co_occurrence", 0.5), total(pairs(graph.topic_links(conversations)), "topics", 0.3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_TITLED = "(SELECT DISTINCT id, coalesce(title, '') || ' ' || coalesce(array_to_string(topics, ' '), '') AS t FROM conversations)"
_NAMED = "(SELECT DISTINCT id, coalesce(name, '') || ' ' || coalesce(array_to_string(aliases, ' '), '') AS t FROM entities)"
_DOMAIN_ITEMS = " UNION ALL ".join(f"SELECT '{d}' AS domain, (SELECT count(DISTINCT id) FROM {_TITLED} WHERE {_any_sql('t', ks)}) AS conversations, (SELECT count(DISTINCT id) FROM {_NAMED} WHERE {_any_sql('t', ks)}) AS entities" for d, ks in DOMAINS.items())


@query(f"SELECT * FROM ({_DOMAIN_ITEMS}) WHERE conversations + entities > 0")
def domain_items(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations and entities of each domain's index page; an item may have several."""
    joined = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(F.array_join(b, " "), F.lit("")))
    each = lambda name, a, b, out: table(spark, folder, name).select("id", F.explode(T.domains(joined(a, b), DOMAINS)).alias("domain")).groupBy("domain").agg(F.count_distinct("id").alias(out))
    both = each("conversations", "title", "topics", "conversations").join(each("entities", "name", "aliases", "entities"), "domain", "full")
    return both.select("domain", F.coalesce("conversations", F.lit(0)).alias("conversations"), F.coalesce("entities", F.lit(0)).alias("entities")).where("conversations + entities > 0")


# Notes and cards


_TAGS = f"(SELECT doc_id, m['tags'] AS v FROM ({_META}) WHERE m['tags'] IS NOT NULL)"


@query(f"SELECT DISTINCT doc_id, unnest(list_filter(CASE WHEN regexp_matches(v, '^\\[.*\\]$') THEN list_transform(string_split(regexp_replace(v, '^\\[(.*)\\]$', '\\1'), ','), lambda x: regexp_replace(trim(x), '^[\"'']|[\"'']$', '', 'g')) ELSE [v] END, lambda x: x <> '')) AS tag FROM {_TAGS}")
def note_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of notes, a row each."""
    own = table(spark, folder, "documents").select("doc_id", F.try_element_at(T.front_matter(F.col("text")), F.lit("tags")).alias("v"))
    return own.select("doc_id", F.explode(C.list_items(F.col("v"))).alias("tag")).distinct()


@query(f"SELECT key, CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '^\\[.*\\]$') THEN 'list' WHEN lower(value) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$') THEN 'number' WHEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date' ELSE 'text' END AS kind, count(*) AS n FROM ({own_queries.SQL['note_front_matter']}) GROUP BY ALL")
def note_field_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Front matter fields by what their values are."""
    own = own_queries.QUERIES["note_front_matter"](spark, folder)
    return own.groupBy("key", C.value_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


_BY_TAG = "CASE " + " ".join(f"WHEN contains(lower(tag), '{d}') THEN '{d}'" for d in DOMAINS) + " END"


@query(f"SELECT doc_id, coalesce(named, worded) AS domain, coalesce({_case(DECKS, 'coalesce(named, worded)')}, 'General') AS deck FROM (SELECT doc_id, {_first_sql('text', DOMAINS, 'general')} AS worded FROM documents WHERE text IS NOT NULL) LEFT JOIN (SELECT doc_id, max({_BY_TAG}) AS named FROM ({SQL['note_tags']}) GROUP BY doc_id) USING (doc_id)")
def note_decks(spark: SparkSession, folder: str) -> DataFrame:
    """The one domain of each note and its deck."""
    tags = C.list_items(F.coalesce(F.try_element_at(T.front_matter(F.col("text")), F.lit("tags")), F.lit("")))
    own = table(spark, folder, "documents").where("text is not null").select("doc_id", C.single_domain(F.col("text"), tags).alias("domain"))
    return own.select("doc_id", "domain", C.deck(F.col("domain")).alias("deck"))


_PAST = "TIMESTAMPTZ '2025-01-01 00:00:00+00'"
_HISTORY = f"SELECT path, arg_max(h, (updated_at, doc_id)) AS h, max(updated_at) AS seen FROM (SELECT path, doc_id, updated_at, substring(sha256(text), 1, 16) AS h FROM documents WHERE updated_at < {_PAST} AND path IS NOT NULL AND text IS NOT NULL) GROUP BY path"


@query(f"SELECT doc_id FROM documents d LEFT JOIN ({_HISTORY}) e ON d.path = e.path WHERE d.text IS NOT NULL AND (d.path IS NULL OR d.path = '' OR e.path IS NULL OR (e.h <> substring(sha256(d.text), 1, 16) AND NOT floor((epoch_us(TIMESTAMPTZ '2025-01-05 00:00:00+00') - epoch_us(e.seen)) / 86400000000) < 7))")
def cards_due(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose cards are new, or changed and not exported within a week."""
    notes = table(spark, folder, "documents").where("text is not null").select("doc_id", F.col("path").alias("source_id"), F.substring(F.sha2("text", 256), 1, 16).alias("card_hash"), "updated_at")
    past = notes.where((F.col("updated_at") < F.lit("2025-01-01T00:00:00Z").cast("timestamp")) & F.col("source_id").isNotNull())
    history = past.groupBy("source_id").agg(F.max_by("card_hash", F.struct("updated_at", "doc_id")).alias("exported_hash"), F.max("updated_at").cast("timestamp").alias("exported_at"))
    return C.due_cards(notes.select("doc_id", "source_id", "card_hash"), history, F.lit("2025-01-05T00:00:00Z").cast("timestamp")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def vectors_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Notes without a vector."""
    held = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, folder, "documents").select("doc_id").join(held, "doc_id", "left_anti")


@query(f"{_SCORES} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM s")
def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number, mean and bounds of the quality scores."""
    return _scores(spark, folder).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))
