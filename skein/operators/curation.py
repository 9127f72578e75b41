"""Projections of conversations, concepts, entities and notes that curation, exports and indexes are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.jsons import readable
from skein.functions.text import first_domain
from skein.vocab import AGENTS, CARD_FRONTS, DECKS, DOMAINS, ENTITY_TYPES, PLATFORM_AUTHORS, PLATFORM_INGESTERS


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def valid_agent(agent: Column) -> Column:
    """The agent if it is a known one, else null."""
    return F.when(agent.isin(AGENTS), agent)


def provenance(conversations: DataFrame) -> DataFrame:
    """(id, author, ingester, session): the stated agents if known, else those of the platform; the session, its slug or the id."""
    return conversations.select(
        "id", F.coalesce(valid_agent(F.col("author")), _map(PLATFORM_AUTHORS, F.col("platform"))).alias("author"), F.coalesce(valid_agent(F.col("ingested_by")), _map(PLATFORM_INGESTERS, F.col("platform"))).alias("ingester"), F.coalesce(F.nullif("session_id", F.lit("")), F.nullif("session_slug", F.lit("")), F.col("id")).alias("session")
    ).distinct()


def memory_type(concept_type: Column) -> Column:
    """procedural for action items, semantic for all else."""
    return F.when(concept_type == "action_item", "procedural").otherwise("semantic")


def actionable(concept_type: Column) -> Column:
    return concept_type.isin("action_item", "decision")


def all_names(entities: DataFrame) -> DataFrame:
    """(id, name): the distinct names and aliases of each entity, as they stand; null names have no rows."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.where("id is not null").select("id", F.explode(names).alias("name")).where("name is not null").distinct()


def canonical_by_any_name(entities: DataFrame) -> DataFrame:
    """(id, canonical_id): ids merged by equal names or aliases, without regard to case.

    Of each name the first entity that has it (by conversation, place and id) is canonical for those of its type. An id
    with several names goes to the first of their canonical ones; ways over a third entity are not followed.
    """
    place = F.struct(F.coalesce("conversation_id", F.lit("")).alias("c"), F.coalesce("ord", F.lit(-1)).alias("o"), "id")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = entities.where("id is not null").select("id", "entity_type", place.alias("at"), F.explode(names).alias("name")).where("name is not null")
    own = own.select("id", "entity_type", "at", F.lower("name").alias("n"))
    first = own.groupBy("n").agg(F.min(F.struct("at", F.col("entity_type").alias("t"))).alias("f"))
    target = F.when(F.col("entity_type") == F.col("f.t"), F.col("f.at")).otherwise(F.col("at"))
    return own.join(first, "n").groupBy("id").agg(F.min(target).alias("m")).select("id", F.col("m.id").alias("canonical_id"))


def merged_properties(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, key, value): the JSON properties of merged entities; of equal keys the last entity's value counts."""
    own = entities.join(canonical, "id").select("canonical_id", F.struct(F.coalesce("conversation_id", F.lit("")).alias("c"), F.coalesce("ord", F.lit(-1)).alias("o"), "id").alias("at"), F.try_parse_json("properties").alias("p"))
    each = own.select("canonical_id", "at", F.explode(F.try_variant_get("p", "$", "map<string, string>")).alias("key", "value"))
    return each.groupBy("canonical_id", "key").agg(F.max(F.struct("at", "value")).alias("m")).select("canonical_id", "key", "m.value")


def merged_sources(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, conversation_id): every conversation that a merged entity comes from."""
    return entities.join(canonical, "id").select("canonical_id", F.explode("source_conversations").alias("conversation_id")).where("conversation_id is not null").distinct()


def platform_of(exports: DataFrame, payload: str = "payload") -> DataFrame:
    """``exports`` whose payload parses, with the ``platform`` that its first conversation's keys tell; null if none does."""
    own = readable(exports, payload)
    listed = F.try_variant_get("parsed", "$", "array<variant>")
    first = F.coalesce(F.get(listed, F.lit(0)), F.when(listed.isNull(), F.col("parsed")))
    has = lambda k: F.try_variant_get(first, f"$.{k}", "variant").isNotNull()
    in_list = F.when(has("mapping"), "chatgpt").when(has("chat_messages"), "claude").when(has("entries"), "gemini")
    alone = F.when(has("chat_messages"), "claude").when(has("mapping"), "chatgpt").when(has("entries"), "gemini")
    return own.withColumn("platform", F.when(listed.isNotNull(), in_list).otherwise(alone)).drop("parsed")


def list_items(value: Column) -> Column:
    """The items of a front matter value: of '[a, b]' each one without quotes, else the value itself; blank ones fall away."""
    inner = F.regexp_replace(value, r"^\[(.*)\]$", "$1")
    bare = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(F.when(value.rlike(r"^\[.*\]$"), bare).otherwise(F.array(value)), lambda x: x != "")


def value_kind(value: Column) -> Column:
    """What a front matter value is: list, boolean, number, date, empty or text."""
    return F.when(value == "", "empty").when(value.rlike(r"^\[.*\]$"), "list").when(F.lower(value).isin("true", "false"), "boolean").when(value.rlike(r"^-?[0-9]+([.][0-9]+)?$"), "number").when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").otherwise("text")


def single_domain(text: Column, tags: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    """The first domain that a tag names, in the order of tags, else the first that the text's words tell, else 'general'."""
    named = F.flatten(F.transform(tags, lambda t: F.filter(F.array(*map(F.lit, domains)), lambda d: F.contains(F.lower(t), d))))
    return F.coalesce(F.get(named, F.lit(0)), first_domain(text, domains, "general"))


def deck(domain: Column, decks: dict[str, str] = DECKS) -> Column:
    """The deck of a domain."""
    return F.coalesce(_map(decks, domain), F.lit("General"))


def cards(concepts: DataFrame) -> DataFrame:
    """``concepts`` (concept_type, content) with front, back and card_hash. A question is its own front."""
    topic = F.regexp_replace(F.substring("content", 1, 60), "[.,;]+$", "")
    front = F.when(F.col("concept_type") == "question", F.col("content"))
    for kind, words in CARD_FRONTS.items():
        front = front.when(F.col("concept_type") == kind, F.concat(F.lit(words), topic, F.lit("?")))
    back = F.when(F.col("concept_type") == "question", F.lit("")).otherwise(F.col("content"))
    whole = concepts.withColumns({"front": front, "back": back})
    return whole.withColumn("card_hash", F.substring(F.sha2(F.concat_ws("\t", "front", "back"), 256), 1, 16))


def due_cards(candidates: DataFrame, history: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cards (source_id, card_hash) that were never exported, or have changed and were last exported at least ``days`` whole days ago.

    history: (source_id, exported_hash, exported_at), one row a source. Cards without a source always pass; one whose
    exported hash is null never does.
    """
    own = candidates.join(history, "source_id", "left")
    age = F.floor((F.unix_micros(now) - F.unix_micros("exported_at")) / 86_400_000_000)
    gate = F.lit(False) if days <= 0 else F.coalesce(age < days, F.lit(False))
    known = F.col("exported_hash").isNotNull() | F.col("exported_at").isNotNull()
    due = F.col("source_id").isNull() | (F.col("source_id") == "") | ~known | (F.coalesce(F.nullif("exported_hash", F.lit("")) != F.col("card_hash"), F.lit(False)) & ~gate)
    return own.where(due).select(*candidates.columns)


def model_entities(extracted: DataFrame) -> DataFrame:
    """A model's entities with a known type in lower case; an unknown type is a tool."""
    kind = F.lower("entity_type")
    return extracted.withColumn("entity_type", F.when(kind.isin(ENTITY_TYPES), kind).otherwise("tool"))


def model_relations(extracted: DataFrame) -> DataFrame:
    """(id, source_id, target_id, relationship_type, weight, evidence, source_conversation_id): a model's relations as edges."""
    return extracted.select("id", F.col("subject").alias("source_id"), F.col("object").alias("target_id"), F.lit("relates_to").alias("relationship_type"), F.col("confidence").alias("weight"), "evidence", F.col("conversation_id").alias("source_conversation_id")).distinct()


def grounded_confidence(confidence: Column, kept: Column, removed: Column) -> Column:
    """Confidence less 0.15 for each removed quote, not below 0; at least 0.3 if all are removed. Null counts as 0.5."""
    left = F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5)) - 0.15 * removed)
    return F.when((removed > 0) & (kept == 0), F.greatest(left, F.lit(0.3))).otherwise(left)


def action_items(text: Column) -> Column:
    """The action items of a free text: marked list lines, 'Action items:' and open checkboxes; null gives null."""
    pattern = "(?id)(?:[-*•]\\s*(?:TODO|Action item|Task|Follow-?up)[:\\s]+(.+)|Action items?:\\s*(.+?)(?:\n|$)|[-*•]\\s*\\[\\s*\\]\\s*(.+))"
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    each = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.regexp_replace(F.concat(a, b), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.filter(each, lambda x: x != "")


def event_days(events: DataFrame) -> DataFrame:
    """(day, id, events, people, first_us, types): a calendar day's events as one conversation; types in the order they first come."""
    own = events.where("ts is not null").withColumn("day", F.to_date("ts"))
    types = own.groupBy("day", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    # a row for each type of a day is gathered, not one for each event
    names = types.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))
    whole = own.groupBy("day").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("people"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"))
    return whole.join(names, "day").select("day", F.concat(F.lit("calendar-"), F.date_format("day", "yyyy-MM-dd")).alias("id"), "events", "people", "first_us", "types")
