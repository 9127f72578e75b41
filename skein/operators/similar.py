"""Statements compared by the matching-blocks ratio, with a bounded number of others or with all that their signs and sizes allow."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegralType

from skein.functions.text import contradicts, negation_flags, replaces
from skein.plans.blocks import ROWS, running_sum, sortable, with_block
from skein.session import checkpoint

LOOK_BACK = 50


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters by all characters of both; the order of the two matters. Null gives null."""
    return _ratio(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths allow the ratio; decides most pairs before any is compared."""
    return 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))


def numbered(df: DataFrame, order: str, ties: list[str], out: str = "rn", rows: int = ROWS) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of a number and then ``ties``, strings or whole numbers; no task orders them all."""
    one = df.withColumns({"__all": F.lit(1), "__one": F.lit(1)})
    one = checkpoint(one.withColumn("__tie", sortable(*map(F.col, ties), sizes=tuple(isinstance(df.schema[t].dataType, IntegralType) for t in ties))))
    placed = with_block(one, ["__all"], order, rows, "__block", "__tie")
    return running_sum(placed, ["__all"], "__block", [F.col(order).asc_nulls_first(), "__tie"], "__one", out).drop("__all", "__one", "__tie", "__block")


def looked_back(statements: DataFrame, signal: Column, look_back: int = LOOK_BACK) -> DataFrame:
    """Pairs (newer.*, older_id, older_text, older_rn) of the statements for which ``signal`` holds with those of their type among the
    ``look_back`` before them in time.

    statements: (id, type, text, at), at a number; ties go by id. Joined on stretches of ``look_back`` places, of which a
    statement meets its own and the one before, so that there are at most twice ``look_back`` candidates each.
    """
    placed = numbered(statements.where("text is not null"), "at", ["id"])
    stretch = F.floor(F.col("rn") / look_back)
    newer = placed.where(signal).withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    older = placed.select(F.col("id").alias("older_id"), F.col("type").alias("older_type"), F.col("text").alias("older_text"), F.col("rn").alias("older_rn"), stretch.alias("stretch"))
    near = newer.join(older, "stretch").where((F.col("older_rn") < F.col("rn")) & (F.col("older_rn") >= F.col("rn") - look_back) & (F.col("type") == F.col("older_type")))
    return near.drop("stretch", "older_type")


def superseded(statements: DataFrame, threshold: float = 0.4, look_back: int = LOOK_BACK) -> DataFrame:
    """(id, superseded_by): statements that a later one of their type replaces, by its words and a ratio of ``threshold``.

    Each is replaced once, by the first that does. No statements: no rows.
    """
    near = looked_back(statements, replaces(F.col("text")), look_back).where(may_reach(F.col("older_text"), F.col("text"), threshold))
    alike = near.withColumn("r", ratio(F.lower("older_text"), F.lower("text"))).where(F.col("r") >= threshold)
    return alike.groupBy(F.col("older_id").alias("id")).agg(F.min_by("id", "rn").alias("superseded_by"))


@pandas_udf(DoubleType())
def _ratio_if(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    """The ratio, null where the counts of characters already keep it under the threshold."""
    each = ((SequenceMatcher(None, x, y), t) for x, y, t in zip(a, b, threshold))
    return pd.Series([m.ratio() if m.quick_ratio() >= t else None for m, t in each], dtype="float64")


#: Parts of a class of statements that are joined apart.
SALTS = 16


def contradictions(statements: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id_a, id_b, weight): statements of one type and different groups of which one negates what the other asserts.

    statements: (id, type, text, at, group), at a number; a is the earlier one, ties go by id; null texts and ids take no
    part. All are compared, exactly: different texts meet by type, by flags that oppose each other and by lengths that
    allow the ratio (at least ``threshold``, above 0), then by their counts of characters; what is left is matched.
    """
    own = statements.where("text is not null and id is not null").select("id", "type", "text", "group", F.struct(F.col("at").isNotNull().alias("known"), F.coalesce("at", F.lit(0)).alias("at"), "id").alias("place")).distinct()
    flags = negation_flags(F.col("text"))
    texts = own.groupBy("type", "text").agg(F.min("place").alias("first"), F.max("place").alias("last")).select("*", F.lower("text").alias("low"), F.array(*flags).alias("flags")).where("low != ''")
    # lengths of a ratio of at most (2 - threshold) / threshold lie in the same or in adjoining classes
    base = max(2.0, (2 - threshold) / threshold) * 1.001
    texts = checkpoint(texts.withColumn("size", F.floor(F.log(F.length("low")) / F.log(F.lit(base)))))
    kinds = texts.select("type", "flags").distinct()
    bits = lambda c: [F.col(c)[i] for i in range(len(flags))]
    opposed = kinds.withColumnRenamed("flags", "flags_a").join(kinds.withColumnRenamed("flags", "flags_b"), "type").where(contradicts(bits("flags_a"), bits("flags_b")))
    size = F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size")
    older = texts.select("type", F.col("flags").alias("flags_a"), F.col("text").alias("text_a"), F.col("low").alias("low_a"), "first", size).join(opposed, ["type", "flags_a"])
    older = older.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    newer = texts.select("type", F.col("flags").alias("flags_b"), F.col("text").alias("text_b"), F.col("low").alias("low_b"), "last", "size", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("salt"))
    near = older.join(newer, ["type", "flags_b", "size", "salt"]).where((F.col("first") < F.col("last")) & may_reach(F.col("low_a"), F.col("low_b"), threshold))
    alike = near.withColumn("r", _ratio_if("low_a", "low_b", F.lit(threshold))).where(F.col("r") >= threshold).select("type", "text_a", "text_b", "r")
    named = lambda s: own.select("type", F.col("text").alias(f"text_{s}"), F.col("id").alias(f"id_{s}"), F.col("group").alias(f"group_{s}"), F.col("place").alias(f"place_{s}"))
    pairs = alike.join(named("a"), ["type", "text_a"]).join(named("b"), ["type", "text_b"]).where((F.col("place_a") < F.col("place_b")) & ~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False)))
    return pairs.select("id_a", "id_b", F.round("r", 3).alias("weight")).distinct()


def stale(statements: DataFrame, now: Column, days: int = 90, least: float = 0.7) -> DataFrame:
    """Statements (at in microseconds, confidence) that were sure and have not been confirmed for so many whole days before ``now``."""
    age = F.floor((F.unix_micros(now) - F.col("at")) / 86_400_000_000)
    return statements.where((age >= days) & (F.col("confidence") >= least))


MOST = 200


def merged_concepts(by_rule: DataFrame, by_model: DataFrame, threshold: float = 0.85, most: int = MOST) -> DataFrame:
    """(conversation_id, ord, concept_type, content, confidence, confirmed) of two extractions of conversations, in order.

    Both have (conversation_id, rank, concept_type, content, confidence), of which the first ``most`` of a conversation
    count, so that what one task holds is bounded. A model's concept that a rule also found (one type, ratio of the
    normalised texts) gains 0.05 up to 0.95; a rule's own is kept with at most 0.7, and later ones may match it.
    """
    both = by_model.select("*", F.lit(0).alias("s")).unionByName(by_rule.select("*", F.lit(1).alias("s"))).where(F.col("rank") <= most)
    even = F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))
    schema = "conversation_id STRING, ord INT, concept_type STRING, content STRING, confidence DOUBLE, confirmed BOOLEAN"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []

        def done() -> Iterator[pd.DataFrame]:
            if kept:
                yield pd.DataFrame([(current, i, k[0], k[1], k[3], k[4]) for i, k in enumerate(kept)], columns=["conversation_id", "ord", "concept_type", "content", "confidence", "confirmed"])

        for batch in batches:
            for c, s, kind, content, text, confidence in batch.itertuples(index=False, name=None):
                if c != current:
                    yield from done()
                    current, kept = c, []
                same = next((k for k in kept if s and k[0] == kind and (text == k[2] or SequenceMatcher(None, text, k[2]).ratio() >= threshold)), None)
                if same is None:
                    kept.append([kind, content, text, min(confidence, 0.7) if s else confidence, False])
                else:
                    same[3], same[4] = min(0.95, same[3] + 0.05) if same[3] < 0.95 else same[3], True
        yield from done()

    rows = both.select("conversation_id", "s", "concept_type", "content", even.alias("text"), "confidence", "rank").repartition("conversation_id").sortWithinPartitions("conversation_id", "s", "rank", "content")
    return rows.drop("rank").mapInPandas(run, schema)
