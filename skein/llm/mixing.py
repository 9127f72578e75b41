"""Problem 9: a mix of sources whose tokens follow target shares, repeating no document more often than its source allows.

The documents of a source are shuffled by a hash and cut into blocks of equal tokens, sized by source. A low-discrepancy schedule (the van
der Corput points of the slots' numbers, mapped through the cumulative weights) says which source each slot of the mix
takes its next block from; slots are ranked within their source and joined to its blocks. A source of any share of all
rows is ranked and summed in blocks, never by one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.plans.blocks import running_sum, with_block
from skein.session import checkpoint

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Tokens of a source's blocks, if it still has MIN_BLOCKS of them; blocks of smaller sources are smaller.
BLOCK_TOKENS, MIN_BLOCKS = 8192, 2048
#: Slots that are ranked by one task.
SLOT_BLOCK = 100_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (null and empty: 0) by the tokenizer file at ``path``."""
    path = path or tokenizer_path()
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], schema=arrow)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[int, list[tuple[str, float, int]]]:
    """(tokens of the mix, [(source, share, max_repeats)] of the sources that have tokens).

    Without ``total``, the mix is as large as the target shares and the repeats allow. With it, a source that would need
    more repeats than it may have is held at its cap, and the others share the rest by their weights.
    """
    live = [(s, w, r) for s, w, r in targets if totals.get(s, 0) > 0 and w and w > 0 and r and r > 0]
    if not live:
        return 0, []
    weight = sum(w for _, w, _ in live)
    live = [(s, w / weight, r) for s, w, r in live]
    most = {s: totals[s] * r for s, _, r in live}
    if total is None:
        return int(min(most[s] / w for s, w, _ in live)), live
    total = min(total, sum(most.values()))
    share, free = {}, dict((s, w) for s, w, _ in live)
    rest = float(total)
    while free:
        even = sum(free.values())
        capped = [s for s, w in free.items() if rest * w / even >= most[s]]
        if not capped:
            share |= {s: rest * w / even / total for s, w in free.items()}
            break
        for s in capped:
            share[s] = most[s] / total
            del free[s]
        rest = total - sum(most[s] for s in share)
    return total, [(s, share[s], r) for s, _, r in live]


def block_tokens(total: int) -> int:
    """Tokens of each block of a source of so many tokens."""
    return max(1, min(BLOCK_TOKENS, total // MIN_BLOCKS))


def _literals(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def schedule(spark, slots: int, shares: list[tuple[str, float, int]]) -> DataFrame:
    """(slot, source, max_repeats, nth): which source each slot draws from, and its how manieth of that source it is."""
    bits = max(1, math.ceil(math.log2(max(slots, 2))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / float(2**bits)
    cumulative, ends = 0.0, []
    for _, w, _ in shares:
        cumulative += w
        ends.append(cumulative)
    names, caps = F.array(*(F.lit(s) for s, _, _ in shares)), F.array(*(F.lit(int(r)) for _, _, r in shares))
    index = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("point"))), F.lit(len(shares) - 1))
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("i", index)
    drawn = drawn.select("slot", F.get(names, F.col("i")).alias("source"), F.get(caps, F.col("i")).alias("max_repeats"), F.floor(F.col("slot") / SLOT_BLOCK).alias("part"), F.lit(1).alias("one"))
    return running_sum(drawn, ["source"], "part", ["slot"], "one", "nth").drop("part", "one")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(slot, source, repeat, <key>, tokens): the mix, in the order of slot; repeat counts from 0.

    Documents without tokens, of no source or of a source without a target are left out. Of targets that name a source
    twice the greater share counts. No document comes more than max_repeats times. Empty tables give no rows.
    """
    spark = documents.sparkSession
    own = with_tokens(documents.where("source is not null"), [key, "source"], path=path).where("tokens > 0")
    goal = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    own = checkpoint(own.join(goal.select("source"), "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), key)))
    totals = {r.source: r.tokens for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(goal.select("source"), "source").collect()}
    size, shares = plan(totals, [(r.source, r.t.target_share, r.t.max_repeats) for r in goal.collect()], total)
    if not shares:
        return spark.createDataFrame([], f"slot BIGINT, source STRING, repeat BIGINT, {key} {documents.schema[key].dataType.simpleString()}, tokens BIGINT")
    block = {s: block_tokens(totals[s]) for s, _, _ in shares}
    # a source with smaller blocks has its slots more often
    drawn = {s: w / block[s] for s, w, _ in shares}
    often = sum(drawn.values())
    placed = running_sum(with_block(own, ["source"], "h", out="part"), ["source"], "part", ["h", key], "tokens", "before")
    blocks = placed.withColumn("nth_block", F.floor(F.col("before") / F.element_at(_literals(block), F.col("source"))))
    count = _literals({s: -(-totals[s] // block[s]) for s in block})
    slots = schedule(spark, int(size * often), [(s, drawn[s] / often, r) for s, _, r in shares]).withColumn("blocks", F.element_at(count, F.col("source")))
    slots = slots.select("slot", "source", "max_repeats", F.floor(F.col("nth") / F.col("blocks")).alias("repeat"), (F.col("nth") % F.col("blocks")).alias("nth_block")).where("repeat < max_repeats")
    return slots.join(blocks, ["source", "nth_block"]).select("slot", "source", "repeat", key, "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, most_repeats) of each target."""
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    own = targets.select("source", "target_share").join(reached, "source", "left").crossJoin(F.broadcast(whole))  # whole is one row
    return own.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
