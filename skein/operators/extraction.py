"""Extraction by a language model behind a small protocol, with a keyed cache table.

A provider is any object with ``complete(prompt: str) -> str``; it is made by a factory inside the task, so that clients and
keys needn't be pickled. Results are rows (text_hash, stage, prompt_version, model, result, error).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["text_hash", "stage", "prompt_version", "model"]
SCHEMA = "text_hash STRING, stage STRING, prompt_version STRING, model STRING, result STRING, error STRING"


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


def conversation_prompts(messages: DataFrame, tokens: int = 8000) -> DataFrame:
    """(conversation_id, text, text_hash): 'Role: content' lines in order, cut to about ``tokens`` tokens of four characters.

    Only as much of a conversation is gathered as the cut leaves: a line has two characters at least, so messages of a
    position beyond half the cut can't come in and are dropped before anything is ordered.
    """
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    before = F.coalesce(F.sum(F.length("line") + 2).over(Window.partitionBy("conversation_id").orderBy("position", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = messages.where(F.coalesce("position", F.lit(0)) < tokens * 2).withColumn("line", line).withColumn("before", before).where(F.col("before") < tokens * 4)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "line"))), lambda x: x["line"]), "\n\n")
    own = kept.groupBy("conversation_id").agg(text.alias("text"))
    own = own.withColumn("text", F.when(F.length("text") > tokens * 4, F.concat(F.substring("text", 1, tokens * 4), F.lit("\n[...]"))).otherwise(F.col("text")))
    return own.withColumn("text_hash", F.sha2("text", 256))


def extract(texts: DataFrame, cache: DataFrame, stage: str, prompt_version: str, model: str, prompt: str, factory: Callable[[], Provider]) -> tuple[DataFrame, DataFrame]:
    """(results of all texts, rows to add to the cache). texts has text and text_hash; prompt holds '{text}'.

    Texts of one hash are asked for once, those in the cache not at all; a failed call gives its error and no result, and
    isn't cached.
    """
    held = cache.where((F.col("stage") == stage) & (F.col("prompt_version") == prompt_version) & (F.col("model") == model))
    missing = texts.select("text_hash", "text").dropDuplicates(["text_hash"]).join(held, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            out = []
            for h, t in batch.itertuples(index=False, name=None):
                try:
                    out.append((h, stage, prompt_version, model, provider.complete(prompt.replace("{text}", t)), None))
                except Exception as error:  # one text's failure must not cost the others'
                    out.append((h, stage, prompt_version, model, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[*KEYS, "result", "error"])

    asked = missing.select("text_hash", "text").mapInPandas(run, SCHEMA)
    known = held.join(texts.select("text_hash").distinct(), "text_hash", "left_semi").select(*KEYS, "result", F.lit(None).cast("string").alias("error"))
    return known.unionByName(asked), asked.where("error is null").select(*KEYS, "result")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with rows added; a row replaces one of its key."""
    return cache.join(rows.select(*KEYS), KEYS, "left_anti").select(*KEYS, "result").unionByName(rows.select(*KEYS, "result"))


def stage_counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("stage").agg(F.count("*").alias("n"))


def grounded(quote: Column, text: Column, share: float = 0.8) -> Column:
    """Whether a quote stands in a text: as it is, without regard to case, or with ``share`` of its different words in some
    stretch of as many words, which the text must have at least. Null or blank quotes don't."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    q, t = F.array_distinct(words(quote)), words(text)
    n = F.size(q)
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    stretch = F.exists(starts, lambda i: F.size(F.array_intersect(q, F.slice(t, i, n))) >= share * n)
    return F.coalesce((n > 0) & (F.contains(F.lower(text), F.lower(F.trim(quote))) | stretch), F.lit(False))
