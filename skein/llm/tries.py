"""Similarity join of words by tries and Levenshtein automata.

Words go to shards by what one edit can't touch: of two words within one edit or swap of neighbours, either the first part
or the last part (each a little less than half) is the same. Each shard builds a trie of its words and walks it with the
automaton of every word that asks, so no two words are compared one by one. Shards that hold too many words are split, and
the words that ask go to all their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUND = 1
#: Words that one trie holds.
TRIE_WORDS = 20_000


class Automaton:
    """Words within ``bound`` edits (insertion, deletion, substitution, swap of neighbours) of ``word``.

    A state is a set of (place, edits, swapping), relative to its least place; what a state and the pattern of the
    next letter lead to is worked out once and kept for all words.
    """

    _moves: dict[tuple, tuple] = {}

    def __init__(self, word: str, bound: int = BOUND):
        self.word, self.bound = word, bound

    def start(self) -> tuple:
        return 0, ((0, 0, 0),)

    def step(self, state: tuple, letter: str) -> tuple | None:
        base, places = state
        reach = 2 * self.bound + 2
        same = tuple(x == letter for x in self.word[base : base + reach])
        key = (places, same, self.bound)
        if key not in self._moves:
            self._moves[key] = self._move(places, same)
        shift, after = self._moves[key]
        return None if not after else (base + shift, after)

    def _move(self, places: tuple, same: tuple) -> tuple:
        out = set()
        hit = lambda i: i < len(same) and same[i]
        for i, e, swap in places:
            if swap:
                if hit(i):
                    out.add((i + 2, e, 0))
                continue
            if hit(i):
                out.add((i + 1, e, 0))
            if e < self.bound:
                out.add((i, e + 1, 0))
                if i < len(same):
                    out.add((i + 1, e + 1, 0))
                if hit(i + 1):
                    out.add((i, e + 1, 1))
                for skip in range(1, self.bound - e + 1):
                    if hit(i + skip):
                        out.add((i + skip + 1, e + skip, 0))
        kept = {p for p in out if p[2] or not any(not q[2] and q[1] < p[1] and abs(p[0] - q[0]) <= p[1] - q[1] for q in out)}
        if not kept:
            return 0, ()
        base = min(p[0] for p in kept)
        return base, tuple(sorted((i - base, e, s) for i, e, s in kept))

    def accepts(self, state: tuple) -> bool:
        base, places = state
        return any(not s and len(self.word) - base - i + e <= self.bound for i, e, s in places)


def trie(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = word
    return root


def near(root: dict, word: str, bound: int = BOUND) -> Iterator[str]:
    """Words of the trie within ``bound`` edits of ``word``, itself included."""
    automaton = Automaton(word, bound)
    stack = [(root, automaton.start())]
    while stack:
        node, state = stack.pop()
        for letter, child in node.items():
            if letter == "":
                if automaton.accepts(state):
                    yield child
            elif (after := automaton.step(state, letter)) is not None:
                stack.append((child, after))


def neighbours(words: DataFrame, group: str, word: str) -> DataFrame:
    """(group, word, near): all pairs of different words of one group within one edit, both ways round.

    Repeated words count once; null and empty ones have no neighbours. Words of fewer than three letters are compared
    like the others, by the shard of the empty part.
    """
    own = words.select(F.col(group).alias("group"), F.col(word).alias("word")).where("word is not null and word != '' and group is not null").distinct()
    n = F.length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    first = lambda size: F.substring("word", F.lit(1), F.greatest(half(size) - 1, F.lit(0)))
    # the last part is taken by its length from the end
    last_size = lambda size: F.greatest(size - half(size) - 1, F.lit(0))
    last = lambda size: F.when(last_size(size) > n, F.lit(None)).otherwise(F.substring("word", n - last_size(size) + 1, last_size(size)))
    signs = lambda size: F.array(F.concat_ws("|", F.lit("a"), size.cast("string"), first(size)), F.concat_ws("|", F.lit("z"), size.cast("string"), last(size)))
    held = own.select("group", "word", F.explode(signs(n)).alias("sign"))
    asking = own.select("group", "word", F.explode(F.array_distinct(F.flatten(F.array(signs(n - 1), signs(n), signs(n + 1))))).alias("sign"))
    parts = held.groupBy("group", "sign").agg(F.ceil(F.count("*") / TRIE_WORDS).cast("int").alias("parts"))
    # a word that asks where nothing is held drops out here
    held = held.join(parts, ["group", "sign"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("asks", F.lit(False))
    asking = asking.join(parts, ["group", "sign"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(True))
    both = held.unionByName(asking).select("group", "sign", "part", "asks", "word").repartition("group", "sign", "part").sortWithinPartitions("group", "sign", "part", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, root, out = None, {}, []
        for batch in batches:
            for g, sign, part, asks, w in batch.itertuples(index=False, name=None):
                if (g, sign, part) != current:
                    current, root = (g, sign, part), {}
                if asks:
                    out += [(g, w, x) for x in near(root, w) if x != w]
                else:
                    node = root
                    for letter in w:
                        node = node.setdefault(letter, {})
                    node[""] = w
            yield pd.DataFrame(out, columns=["group", "word", "near"])
            out = []

    return both.mapInPandas(run, "group STRING, word STRING, near STRING").distinct()
