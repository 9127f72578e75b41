"""Ordered work on groups of any size: a group is cut into blocks that follow each other in its order, each block is one
unit of work, and the few block summaries are put together by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpoint

#: Rows that one block should hold.
ROWS = 200_000
#: Cuts made at once.
FAN_OUT = 256


def with_block(df: DataFrame, keys: list[str], order: str, rows: int = ROWS, out: str = "block", then: str | None = None, start: Column | None = None) -> DataFrame:
    """``df`` with the block of each row: blocks of a group follow each other in ``order`` (a number; null comes first), and
    rows of equal order in the order of the string ``then``.

    Groups of up to ``rows`` rows are one block, or the blocks (arrays of numbers) that ``start`` gives. Larger ones are cut
    at quantiles of ``order``, which merge partially before any shuffle, again and again while that makes them smaller,
    then at quantiles of ``then`` by the bytes after what all strings of a block begin with. Only rows that are equal in
    both share a block of any size.
    """
    df = df.withColumn(out, F.array().cast("array<int>") if start is None else start.cast("array<int>"))
    df = _cut(df, keys, out, rows, lambda hot: hot.withColumn("__code", F.col(order)))
    if then is None:
        return df

    def code(hot: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(then), F.lit(""))
        ends = hot.groupBy(*keys, out).agg(F.min(text).alias("__low"), F.max(text).alias("__high"))
        shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length("__low"), F.length("__high")), F.lit(1))), lambda i: (F.substring("__low", F.lit(1), i) == F.substring("__high", F.lit(1), i)) & (i <= F.length("__low"))))
        ends = ends.select(*keys, out, shared.alias("__shared"))
        rest = F.substring(F.encode(F.substring(text, F.col("__shared") + 1, F.lit(7)), "utf-8"), 1, 7)
        return _known(hot, ends, [*keys, out]).withColumn("__code", F.conv(F.rpad(F.hex(rest), 14, "0"), 16, 10).cast("bigint")).drop("__shared")

    return _cut(df, keys, out, rows, code)


def sortable(*parts: Column, sizes: tuple[bool, ...] = ()) -> Column:
    """One string in whose order the parts stand; ``sizes`` says which are whole numbers (of less than 2 ** 62). Null comes first."""
    text = lambda c, number: F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(c.cast("bigint") + F.lit(1 << 62)), 16, "0") if number else c.cast("string")), F.lit("0"))
    return F.concat_ws("\0", *(text(c, i < len(sizes) and sizes[i]) for i, c in enumerate(parts)))


def _known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; ``other`` has one row a key."""
    named = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(named, same, "left").drop(*(f"__{k}" for k in keys))


def _cut(df: DataFrame, keys: list[str], out: str, rows: int, code) -> DataFrame:
    """Blocks of more than ``rows`` rows cut at quantiles of the number that ``code`` adds as __code, while cuts help."""
    done, before = [], None
    cuts = [i / FAN_OUT for i in range(1, FAN_OUT)]
    while True:
        sizes = df.groupBy(*keys, out).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
        now = tuple(sizes.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).head())
        if not now[0] or now == before:
            break
        before = now
        marked = _known(df, sizes.withColumnRenamed("__n", "__hot"), [*keys, out])
        done.append(marked.where("__hot is null").drop("__hot"))
        hot = code(marked.where("__hot is not null"))
        points = hot.groupBy(*keys, out).agg(F.array_distinct(F.percentile_approx("__code", cuts, 10_000)).alias("__cuts"))
        place = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__code"))), F.lit(-1)) + 1
        place = F.when(F.col("__code").isNull() | F.col("__cuts").isNull(), 0).otherwise(place)
        placed = _known(hot, points, [*keys, out]).withColumn(out, F.concat(out, F.array(place))).drop("__cuts", "__code", "__hot")
        # what is cut goes on alone, its lineage cut
        df = checkpoint(placed)
    for part in done:
        df = df.unionByName(part)
    return df


def last_known(df: DataFrame, keys: list[str], order: str, value: str, out: str, rows: int = 4096) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row of its group, by the whole number ``order``.

    Blocks are ranges of ``order``; each is a window of its own, and the last value of the blocks before comes from one
    row a block.
    """
    block = F.floor(F.col(order) / rows).alias("__block")
    df = df.select("*", block)
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*keys, "__block").agg(F.max_by(value, order).alias("__end"))
    # where a block ends without a value of its own, the block before it counts: only blocks that have rows matter
    blocks = df.select(*keys, "__block").distinct().join(ends, [*keys, "__block"], "left")
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*keys, "__block", F.last("__end", ignorenulls=True).over(across).alias("__before")).where("__before is not null")
    own = df.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    return own.join(before, [*keys, "__block"], "left").withColumn(out, F.coalesce(out, "__before")).drop("__block", "__before")


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group before each row, by block and then ``order``."""
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("__total"))
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, block, F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(before, [*keys, block]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")
