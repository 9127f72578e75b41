"""Problem 4: pairwise matches consolidated into groups.

The component of the vertex of highest degree is peeled first: breadth-first joins from that vertex, frontier by
frontier, while frontiers are wide. Its vertices are anti-joined away; what is left of it (thin tails, if the walk
stopped early) meets the peeled part in one contracted vertex. The small components that remain are labelled by minimum
propagation: in each round every vertex takes the least vertex near it, follows that pointer four steps, and the pairs
are contracted to what they point to. Vertices are compared by a hash, so that ids in the order of a chain don't slow it
down, and a chain of n links takes about log n rounds. No component or link list is ever brought to the driver; rounds
cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint

#: The walk from the hub goes on while a frontier holds at least this share of what the walk has reached, and for at most
#: so many rounds; both only shift work to the propagation, and no result depends on them.
WIDE, MAX_FRONTIERS = 0.2, 20


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def clean_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, distinct: pairs with a null or empty end and pairs of a thing with itself link nothing."""
    ends = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    return ends.where("x is not null and y is not null and x != '' and y != '' and x != y").select("a", "b").distinct()


def peel(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices of the component of the hub that the walk reached: v, root; the pairs that are left, between root labels).

    pairs: (a, b) with a < b, checkpointed. The hub is the least vertex of highest degree. Pairs between a reached and
    an unreached vertex come back with the hub in place of the reached end.
    """
    links = _both_ways(pairs)
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    top = degree.orderBy(F.desc("n"), "a").limit(1).collect()
    if not top:
        return pairs.select(F.col("a").alias("v"), F.col("a").alias("root")), pairs
    hub = top[0]["a"]
    reached = frontier = pairs.sparkSession.createDataFrame([(hub,)], "v STRING")
    total = 1
    for _ in range(MAX_FRONTIERS):
        near = links.join(frontier, links.a == frontier.v, "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = checkpoint(near.join(reached, "v", "left_anti"))
        wide = frontier.count()
        reached = reached.unionByName(frontier)
        total += wide
        if wide < WIDE * total:
            break
    inside = reached.select(F.col("v").alias("a"), F.lit(True).alias("in_a"))
    marked = pairs.join(inside, "a", "left").join(inside.select(F.col("a").alias("b"), F.col("in_a").alias("in_b")), "b", "left")
    left = marked.where("in_a is null or in_b is null")
    low = F.when(F.col("in_a"), F.lit(hub)).otherwise(F.col("a"))
    high = F.when(F.col("in_b"), F.lit(hub)).otherwise(F.col("b"))
    left = left.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).where("a != b").distinct()
    return reached.select("v", F.lit(hub).alias("root")), checkpoint(left)


def propagate(pairs: DataFrame) -> DataFrame:
    """(v, root): one vertex of its component for each vertex of ``pairs`` (a, b distinct, a != b), the same for all of it."""
    order = F.xxhash64
    steps = []
    while not pairs.isEmpty():
        links = _both_ways(pairs)
        least = links.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(order("b").alias("h"), "b")).alias("m"))
        own = F.struct(order("v").alias("h"), F.col("v").alias("b"))
        pointer = least.select("v", F.least("m", own)["b"].alias("p"))
        for _ in range(2):
            # following pointers twice, then four times; one that isn't at its end yet is followed on in the next round
            pointer = pointer.alias("x").join(pointer.alias("y"), F.col("x.p") == F.col("y.v")).select("x.v", F.col("y.p").alias("p"))
        pointer = checkpoint(pointer)
        steps.append(pointer)
        a, b = (pointer.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        ends = pairs.join(a, "a").join(b, "b")
        pairs = checkpoint(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a != b").distinct())
    labels = steps[0].toDF("v", "root")
    for step in steps[1:]:
        labels = labels.join(step.toDF("root", "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return labels


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member_key, group_key): the group of every vertex, named by its least member (by code point); one row a vertex.

    Null or empty ends, pairs of a thing with itself and repeated or reversed pairs are allowed and add nothing. No
    pairs: no rows.
    """
    own = checkpoint(clean_pairs(pairs, a, b))
    if own.isEmpty():
        return own.select(F.col("a").alias("member_key"), F.col("b").alias("group_key"))
    giant, left = peel(own)
    if left.isEmpty():
        roots = giant
    else:
        small = checkpoint(propagate(left))
        # the contracted vertex passes its label on to all that the walk reached
        of_hub = small.select(F.col("v").alias("root"), F.col("root").alias("label"))
        named = giant.join(of_hub, "root", "left").select("v", F.coalesce("label", "root").alias("root"))
        roots = named.unionByName(small.join(giant, "v", "left_anti"))
    # the root is any member; the group is named by its least
    least = roots.groupBy("root").agg(F.min("v").alias("group_key"))
    return roots.join(least, "root").select(F.col("v").alias("member_key"), "group_key")


KINDS = {"merge": "m", "name": "n"}


def all_groups(merge_map: DataFrame, relationships: DataFrame) -> DataFrame:
    """(kind, group_key, member_key): entity ids merged directly or indirectly (kind merge), and names linked by SAME_AS rows
    of any letter case, trimmed and in lower case (kind name).

    A row for each member but the group's least one, after which the group is named. Both kinds are one graph, their
    vertices told apart by a first letter.
    """
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    same = relationships.where(F.upper(F.trim("predicate")) == "SAME_AS").select(name("subject").alias("x"), name("object").alias("y"))
    merged = merge_map.select(F.col("merged_id").alias("x"), F.col("canonical_id").alias("y"))
    marked = None
    for pairs, letter in ((merged, KINDS["merge"]), (same, KINDS["name"])):
        part = pairs.select(*(F.when(F.col(c) != "", F.concat(F.lit(letter), c)).alias(c) for c in "xy"))
        marked = part if marked is None else marked.unionByName(part)
    grouped = components(marked, "x", "y").where("group_key != member_key")
    kind = F.when(F.col("group_key").startswith(KINDS["merge"]), "merge").otherwise("name")
    return grouped.select(kind.alias("kind"), F.substring("group_key", 2, 1 << 30).alias("group_key"), F.substring("member_key", 2, 1 << 30).alias("member_key"))
