"""Entities, links between them, and their curation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import word_count
from skein.plans.passes import in_passes


def canonical_by_name(entities: DataFrame) -> DataFrame:
    """(id, canonical_id): ids merged by equal name in lower case.

    The first occurrence of a name (by conversation, place and id), of whatever type, is canonical; later ones merge into
    it if they have its type, else they stay themselves. Rows without a name or id are left out.
    """
    own = entities.where("name is not null and id is not null").select("id", F.lower("name").alias("n"), "entity_type", F.struct(F.coalesce("conversation_id", F.lit("")).alias("c"), F.coalesce("ord", F.lit(-1)).alias("o"), "id").alias("at"))
    first = own.groupBy("n").agg(F.min(F.struct("at", F.col("entity_type").alias("t"))).alias("f"))
    merged = own.join(first, "n").select("id", F.when(F.col("entity_type") == F.col("f.t"), F.col("f.at.id")).otherwise(F.col("id")).alias("canonical_id"))
    return merged.groupBy("id").agg(F.min("canonical_id").alias("canonical_id"))


def merged_entities(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, members, first_seen, last_seen) of each merged entity."""
    own = entities.join(canonical, "id")
    return own.groupBy("canonical_id").agg(F.count_distinct("id").alias("members"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merged_aliases(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_id, alias): every other name and alias of a merged entity, a row each, so that no group is gathered."""
    own = entities.join(canonical, "id")
    names = own.select("canonical_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias is not null").distinct()
    main = entities.where("name is not null").groupBy(F.col("id").alias("canonical_id")).agg(F.min("name").alias("name"))
    return names.join(main, "canonical_id", "left").where("name is null or alias != name").select("canonical_id", "alias")


def remap(edges: DataFrame, mapping: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges with both ends replaced by what ``mapping`` (id, canonical_id, one row an id) says; loops fall away, parallel edges stay."""
    a, b = (mapping.select(F.col("id").alias(c), F.col("canonical_id").alias(f"new_{c}")) for c in (source, target))
    moved = edges.join(a, source, "left").join(b, target, "left")
    ends = {c: F.coalesce(f"new_{c}", c) for c in (source, target)}
    return moved.withColumns(ends).drop(f"new_{source}", f"new_{target}").where(F.col(source) != F.col(target)).select(*edges.columns)


def neighbours(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, neighbour): distinct undirected adjacency, a row each."""
    ends = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    return ends(source, target).unionByName(ends(target, source)).where("node is not null and neighbour is not null").distinct()


def co_occurrence(entities: DataFrame) -> DataFrame:
    """(conversation_id, id, links): how many other entities each one shares its conversation with.

    The pairs themselves follow from it and are not written out: a conversation of n entities has n (n - 1) / 2.
    """
    own = entities.where("conversation_id is not null and id is not null").select("conversation_id", "id").distinct()
    sizes = own.groupBy("conversation_id").agg((F.count("*") - 1).alias("links"))
    return own.join(sizes, "conversation_id").select("conversation_id", "id", "links")


def topic_links(conversations: DataFrame) -> DataFrame:
    """(topic, id, first_id, links): each conversation of a topic, the topic's first one, and how many it links to."""
    own = conversations.where("id is not null").select("id", F.explode("topics").alias("topic")).where("topic is not null").distinct()
    sizes = own.groupBy("topic").agg(F.min("id").alias("first_id"), (F.count("*") - 1).alias("links"))
    return own.join(sizes, "topic").select("topic", "id", "first_id", "links")


#: Bytes of names sent to the tasks at once.
NAME_BLOCK = 32_000_000


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """(key, name): distinct names, in lower case, that a text holds as substrings, without regard to case.

    The names are searched for by an Aho-Corasick automaton, in blocks of bounded size with one pass over the texts a
    block; blank names and null texts have no matches.
    """

    def search(shared) -> DataFrame:
        return texts.select(key, F.lower(text).alias("__text")).where("__text is not null").mapInArrow(_searcher(shared, key), f"{key} {texts.schema[key].dataType.simpleString()}, name STRING")

    return in_passes(texts.sparkSession, _blocks(names.select(F.lower(name).alias("n")).where("trim(n) != ''").distinct()), search).distinct()


def entity_mentions(concepts: DataFrame, entities: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(concept_id, entity_id): every entity whose name, without regard to case, is part of a concept's text.

    All distinct names of ``entities`` are searched for, and every id of a name found counts. Blank names and null ids
    have no rows.
    """
    held = mentions(concepts.where(F.col(key).isNotNull()), key, text, entities)
    named = entities.where("id is not null").select(F.lower("name").alias("name"), F.col("id").alias("entity_id")).distinct()
    return held.join(named, "name").select(F.col(key).alias("concept_id"), "entity_id").distinct()


def _blocks(names: DataFrame) -> Iterator[list[str]]:
    block, size, any_ = [], 0, False
    for row in names.toLocalIterator():
        if size > NAME_BLOCK:
            yield block
            block, size, any_ = [], 0, True
        block.append(row.n)
        size += len(row.n)
    if block or not any_:
        yield block


def _searcher(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in shared.value:
            automaton.add_word(n, n)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist() if shared.value else []):
                for n in {n for _, n in automaton.iter(t)}:
                    at.append(i)
                    out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=[key, "name"])

    return run


# Scores of sources.

#: Weights and caps of the signals of a source's score.
WEIGHTS = {"messages": 0.20, "words": 0.20, "mean": 0.15, "model": 0.10, "duration": 0.10, "topics": 0.10, "conclusions": 0.15}
CAPS = {"messages": 30, "words": 6000, "mean": 200, "duration": 7200.0, "topics": 5}


def source_scores(messages: DataFrame, conversations: DataFrame, concepts: DataFrame, stamp: str) -> DataFrame:
    """(conversation_id, score): seven signals in [0, 1], weighted: messages, words, words a message, whether a model is named,
    seconds between first and last ``stamp``, topics, and whether a decision or action item was found."""
    own = messages.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.sum(F.coalesce(word_count(F.col("content")), F.lit(0))).alias("words"), F.max(F.col("model").isNotNull().cast("int")).alias("model"),
        F.when(F.count(stamp) >= 2, (F.unix_micros(F.max(stamp)) - F.unix_micros(F.min(stamp))) / 1_000_000).alias("duration"),
    )
    topics = conversations.where("id is not null").groupBy(F.col("id").alias("conversation_id")).agg(F.max(F.coalesce(F.size("topics"), F.lit(0))).alias("topics"))
    concluded = concepts.where("concept_type in ('decision', 'action_item')").select("conversation_id").distinct().withColumn("conclusions", F.lit(1))
    all_ = own.join(topics, "conversation_id", "left").join(concluded, "conversation_id", "left")
    capped = lambda c, top: F.least(F.coalesce(c, F.lit(0)) / F.lit(float(top)), F.lit(1.0))
    signal: dict[str, Column] = {
        "messages": capped(F.col("messages"), CAPS["messages"]), "words": capped(F.col("words"), CAPS["words"]), "mean": capped(F.col("words") / F.col("messages"), CAPS["mean"]),
        "model": F.col("model").cast("double"), "duration": capped(F.col("duration"), CAPS["duration"]), "topics": capped(F.greatest(F.col("topics"), F.lit(0)), CAPS["topics"]), "conclusions": F.coalesce(F.col("conclusions"), F.lit(0)).cast("double"),
    }
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.lit(weight) * signal[name]
    return all_.select("conversation_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def histogram(values: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """(bin, n): equal bins over [0, 1], values outside in the outer ones; empty bins have no row."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) * bins).cast("int")))
    return values.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def percentiles(values: DataFrame, value: str, points: list[float], digits: int = 4) -> DataFrame:
    """(point, value): nearest-rank percentiles of values in [0, 1], rounded to ``digits`` first, which bounds the number of
    different values whatever the rows. No values: no rows."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.round(value, digits).alias("v")).agg(F.count("*").alias("n"))
    # at most 10 ** digits + 1 rows are left here
    running = counts.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    each = running.select("v", "upto", "all", F.explode(F.array(*map(F.lit, points))).alias("point"))
    return each.where(F.col("upto") >= F.ceil(F.col("point") * F.col("all"))).groupBy("point").agg(F.min("v").alias("value"))
