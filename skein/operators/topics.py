"""Topics and concepts of conversations by keywords and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import phrase_count, spaced, word_count, words
from skein.vocab import CONCEPT_PATTERNS, TOOLS, TOPICS


def deliveries(messages: DataFrame) -> DataFrame:
    """Messages delivered more than once, once: distinct apart from the time of delivery."""
    return messages.select("conversation_id", "position", "id", "role", "content", "model", "tokens").distinct()


def topic_scores(messages: DataFrame, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """(conversation_id, topic, ord, hits, score): whole-word keyword hits of each topic by words of the conversation.

    Conversations without words or hits have no rows. Hits are summed per message before the shuffle.
    """
    text = messages.where("content is not null").select("conversation_id", word_count(F.col("content")).alias("n"), spaced(words(F.col("content"))).alias("t"))
    counts = []
    for i, (topic, keywords) in enumerate(topics.items()):
        hits = sum((phrase_count(F.col("t"), k) for k in keywords), F.lit(0))
        counts.append(F.struct(F.lit(topic).alias("topic"), F.lit(i).alias("ord"), hits.cast("bigint").alias("hits")))
    each = text.select("conversation_id", "n", F.inline(F.array(*counts)))
    summed = each.groupBy("conversation_id", "topic", "ord").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return summed.where("hits > 0 and n > 0").select("conversation_id", "topic", "ord", "hits", (F.col("hits") / F.col("n")).alias("score"))


def topics_of(scores: DataFrame, most: int = 5) -> DataFrame:
    """(conversation_id, rank, topic, score, confidence): the best topics, ties by their order; confidence from the best."""
    own = Window.partitionBy("conversation_id").orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("rank", F.row_number().over(own)).withColumn("confidence", F.least(F.first("score").over(own) * 100, F.lit(1.0)))
    return ranked.where(F.col("rank") <= most).select("conversation_id", "rank", "topic", "score", "confidence")


def tools_in(messages: DataFrame, tools: list[str] = TOOLS) -> DataFrame:
    """(conversation_id, tool): tools named as whole words, once a conversation."""
    found = messages.where("content is not null").select("conversation_id", F.explode(F.array_intersect(words(F.col("content")), F.array(*map(F.lit, tools)))).alias("tool"))
    return found.distinct()


def _numbered(head: tuple):
    return lambda c, j: F.struct(*head, j.alias("j"), F.trim(c).alias("content"))


def concepts(messages: DataFrame, patterns: list[tuple[str, str]] = CONCEPT_PATTERNS, most: int = 200) -> DataFrame:
    """(conversation_id, concept_type, content, rank): what the patterns capture, each content once a conversation and type.

    Contents have 10 to 500 characters; case tells no contents apart. The first ``most`` of a conversation are kept
    (0: all) in the order of type, pattern, message and match. Each message is a text of its own.
    """
    rows = messages.where("content is not null").select("conversation_id", F.coalesce("position", F.lit(-1)).alias("at"), "id", F.regexp_replace("content", r"\n+$", "").alias("t"))
    kinds = list(dict.fromkeys(k for k, _ in patterns))
    arrays = []
    for i, (kind, pattern) in enumerate(patterns):
        found = F.regexp_extract_all("t", F.lit("(?id)" + pattern), F.lit(1))
        head = F.lit(kinds.index(kind)).alias("k"), F.lit(i).alias("p")
        arrays.append(F.transform(found, _numbered(head)))
    each = rows.select("conversation_id", "at", "id", F.inline(F.concat(*arrays))).where(F.length("content").between(10, 500))
    order = F.struct("k", "p", "at", "id", "j", "content")
    first = each.groupBy("conversation_id", "k", F.lower("content").alias("low")).agg(F.min(order).alias("o"))
    named = first.select("conversation_id", F.get(F.array(*map(F.lit, kinds)), F.col("k")).alias("concept_type"), F.col("o.content").alias("content"), "o")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("conversation_id").orderBy("o")))
    return (ranked.where(F.col("rank") <= most) if most > 0 else ranked).drop("o")
