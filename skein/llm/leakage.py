"""Problem 8: passages of held-out items inside a corpus, by suffix arrays over shards of the corpus.

Each shard (a bounded number of words of one partition) is brought to the canonical form of ``canonical``, case-folded and
cut into words, vectorially; words outside the items' vocabulary end every match, so only runs of known words enter the
shard's suffix array. Every suffix of every item is then searched in it. The corpus is not shuffled.

The items are a stated query set: they are sent to the tasks in blocks of at most ``BLOCK_POINTS`` characters, whatever
their number, with one pass over the corpus a block, one after the other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.canonical import POINTS, canonical_points, gather, slices, to_points
from skein.plans.passes import in_passes

MIN_WORDS = 10
#: Known words that one suffix array holds at most (a single longer document aside).
SHARD_WORDS = 1_000_000
#: Places in a shard at which passages are compared at once.
SPREAD_PLACES = 2_000_000
#: Characters of items sent to the tasks at once.
BLOCK_POINTS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def word_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Case folding as a table of expansions (marks fold to nothing), and which points are letters or digits."""
    length, start = np.ones(POINTS, np.uint8), np.arange(POINTS, dtype=np.int32)
    flat, extra, inside = np.arange(POINTS, dtype=np.uint32), [], np.zeros(POINTS, bool)
    for p in range(POINTS):
        c = chr(p)
        kind = unicodedata.category(c)[0]
        inside[p] = kind in "LN"
        full = "" if kind == "M" else c.casefold() if kind == "L" else c
        if full != c:
            length[p], start[p] = len(full), POINTS + len(extra)
            extra += map(ord, full)
    return length, start, np.concatenate([flat, np.array(extra, np.uint32)]), inside


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words of the texts, and the offsets of the texts among them."""
    length, start, flat, inside = word_tables()
    points, offsets = gather(*canonical_points(*to_points(texts)), length, start, flat)
    word = inside[points] if len(points) else np.zeros(0, bool)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(points)]
    begins[edge] = word[edge]
    at = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(begins)])
    if not len(at):
        return np.zeros(0, np.uint64), before[offsets]
    chars = np.flatnonzero(word)
    owner = before[chars + 1] - 1
    place = np.arange(len(chars)) - np.searchsorted(owner, np.arange(len(at)))[owner]
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    firsts = np.flatnonzero(place == 0)
    keys = np.add.reduceat((points[chars].astype(np.uint64) + np.uint64(1)) * powers[place], firsts)
    return keys ^ (keys >> np.uint64(29)), before[offsets]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes at least, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class Items:
    """A block of items, ready to be searched for: the words' vocabulary and every suffix of at least ``min_words`` words."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        keys, offsets = word_keys(pa.array(texts, pa.string()))
        self.min_words = min_words
        self.vocabulary = np.unique(keys)
        codes = np.searchsorted(self.vocabulary, keys) + 1
        self.longest = int(np.diff(offsets).max()) if len(texts) else 0
        starts = [np.arange(a, b - min_words + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= min_words]
        self.starts = np.concatenate([np.zeros(0, np.int64), *starts])
        self.item = np.repeat(np.arange(len(ids)), [max(0, b - a - min_words + 1) for a, b in zip(offsets[:-1], offsets[1:])])
        self.ids = np.array(ids, np.int64)
        self.end = offsets[1:][self.item] if len(self.item) else np.zeros(0, np.int64)
        self.codes = codes
        # suffixes with equal heads are searched once
        heads = codes[self.starts[:, None] + np.arange(min_words)] if len(self.starts) else np.zeros((0, min_words), np.int64)
        self.heads, self.head_of = np.unique(heads, axis=0, return_inverse=True)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Code of each word, 0 if no item has it."""
        if not len(self.vocabulary):
            return np.zeros(len(keys), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == keys, at + 1, 0).astype(np.int32)

    def search(self, codes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(owner, item id, words, place in the owner, place in the item) of the matches in a shard, longest of each start."""
        if not len(codes) or not len(self.heads):
            return
        order = suffix_array(codes, max(self.min_words, self.longest))
        padded = np.concatenate([codes, np.zeros(self.longest + self.min_words, np.int32)])
        low = self._bound(order, padded, False)
        high = self._bound(order, padded, True)
        count = high - low
        hits = np.flatnonzero(count[self.head_of] > 0)
        # passages that repeat are spread out a bounded number of places at a time
        ends = np.cumsum(count[self.head_of[hits]])
        begin = 0
        while begin < len(hits):
            base = ends[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(ends, base + SPREAD_PLACES, "right")))
            yield self._spread(hits[begin:to], low, count, order, padded, owner, place)
            begin = to

    def _spread(self, hit: np.ndarray, low: np.ndarray, count: np.ndarray, order: np.ndarray, padded: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        n = count[self.head_of[hit]]
        which = np.repeat(hit, n)
        at = order[np.repeat(low[self.head_of[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        mine = np.concatenate([self.codes, np.zeros(1, self.codes.dtype)])
        words, live = np.full(len(which), self.min_words), np.arange(len(which))
        while len(live):
            s, e = self.starts[which[live]] + words[live], self.end[which[live]]
            live = live[(s < e) & (mine[np.minimum(s, len(mine) - 1)] == padded[at[live] + words[live]])]
            words[live] += 1
        return owner[at], self.ids[self.item[which]], words, place[at], self.starts[which] - (self.end[which] - np.bincount(self.item, minlength=len(self.ids))[self.item[which]] - self.min_words + 1)

    def _bound(self, order: np.ndarray, padded: np.ndarray, right: bool) -> np.ndarray:
        low, high = np.zeros(len(self.heads), np.int64), np.full(len(self.heads), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            seen = padded[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(self.min_words)]
            differ = seen != self.heads
            first = differ.argmax(1)
            row = np.arange(len(first))
            same = ~differ.any(1)
            less = np.where(same, right, seen[row, first] < self.heads[row, first])
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low


def _runs(codes: np.ndarray, offsets: np.ndarray, min_words: int) -> np.ndarray:
    """Places in runs of at least ``min_words`` known words of one text."""
    known = codes > 0
    fresh = known.copy()
    fresh[1:] &= ~known[:-1]
    edge = offsets[:-1][offsets[:-1] < len(codes)]
    fresh[edge] = known[edge]
    run = np.cumsum(fresh) - 1
    size = np.bincount(run[known], minlength=1) if known.any() else np.zeros(1, int)
    return np.flatnonzero(known & (size[run] >= min_words))


def matches(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc key, item_id, words, doc_word, item_word): longest verbatim match of each document and item, and where it is.

    Words are runs of letters and digits of the canonical form, without regard to case. Null or empty texts match
    nothing; items of fewer than ``min_words`` words can't leak. Ties go to the first place in the document, then the item.
    """

    def search(shared) -> DataFrame:
        own = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
        return own.mapInArrow(_searcher(shared, min_words), "doc BIGINT, item_id BIGINT, words INT, doc_word INT, item_word INT")

    found = in_passes(documents.sparkSession, (Items(*block, min_words) for block in item_blocks(items)), search)
    best = found.groupBy("doc", "item_id").agg(F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m"))
    return best.select(F.col("doc").alias(key), "item_id", F.col("m.words").alias("words"), (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of at most BLOCK_POINTS characters, read one block after the other; one empty block if there are none."""
    ids, texts, size, any_ = [], [], 0, False
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        if texts and size + len(row.text) > BLOCK_POINTS:
            yield ids, texts
            ids, texts, size, any_ = [], [], 0, True
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if texts or not any_:
        yield ids, texts


def _searcher(shared, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        codes, owners, places, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for doc, item, words, doc_word, item_word in items.search(*map(np.concatenate, (codes, owners, places))):
                # the longest match of a document and item, before anything is shuffled
                order = np.lexsort((item_word, doc_word, -words, item, doc))
                doc, item, words, doc_word, item_word = (x[order] for x in (doc, item, words, doc_word, item_word))
                best = np.ones(len(doc), bool)
                best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[best], pa.int64()), "item_id": pa.array(item[best], pa.int64()), **{k: pa.array(v[best], pa.int32()) for k, v in (("words", words), ("doc_word", doc_word), ("item_word", item_word))}})

        for batch in batches:
            docs = np.asarray(batch.column(0))
            for a, b in slices(batch.column(1)):
                keys, offsets = word_keys(batch.column(1).slice(a, b - a))
                own = items.known(keys)
                kept = _runs(own, offsets, min_words)
                if not len(kept):
                    continue
                owner = np.searchsorted(offsets, kept, "right") - 1
                # 0 ends each run, so that no match goes on into the next
                cut = np.flatnonzero((np.diff(kept) > 1) | (np.diff(owner) > 0)) + 1
                codes.append(np.append(np.insert(own[kept], cut, 0), np.int32(0)))
                owners.append(np.append(np.insert(docs[a:b][owner], cut, 0), 0))
                place = kept - offsets[owner]
                places.append(np.append(np.insert(place, cut, 0), 0))
                size += len(kept)
                if size >= SHARD_WORDS:
                    yield from flush()
                    codes, owners, places, size = [], [], [], 0
        if size:
            yield from flush()

    return run


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no passage of ``min_words`` words of an item."""
    leaked = matches(documents, items, min_words, key, text).select(key).distinct()
    return documents.join(leaked, key, "left_anti")
