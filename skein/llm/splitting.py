"""Problem 2: oversized texts cut into pieces at natural boundaries, each piece repeating the end of the one before.

Candidate cuts are the ends of paragraphs, lines, sentences, clauses and words, and, only where these lie too far apart, a
grid of hard cuts. Dynamic programming over them picks the cuts of least total penalty and size imbalance among all that
keep every piece, overlap included, within the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LIMIT, OVERLAP = 2000, 200
#: An overlap may be shorter by this share of it, to begin with a word.
SLACK = 0.2
#: Penalties of a cut, by what ends there.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "clause": 4.0, "word": 6.0, "hard": 60.0}
#: Weight of a piece's squared deviation from the even size, relative to it.
IMBALANCE = 10.0
#: Penalty of one more piece.
PIECE = 5.0
HARD_STEP = 50
_BOUNDARY = re.compile(
    r"(?P<paragraph>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?P<sentence>[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）”]*\s*)"
    r"|(?P<clause>[,;:]\s+|[，、；：]\s*)|(?P<word>\s+)"
)


def candidates(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut, the end included, and their penalties."""
    place, penalty = [], []
    for m in _BOUNDARY.finditer(text):
        if m.end() < len(text):
            place.append(m.end())
            penalty.append(PENALTY[m.lastgroup])
    place.append(len(text))
    penalty.append(0.0)
    ends = np.array([0, *place])
    reach = limit - overlap
    step = max(1, min(HARD_STEP, reach // 4))
    for a, b in zip(ends[:-1][np.diff(ends) > reach], ends[1:][np.diff(ends) > reach]):
        for p in range(int(a) + step, int(b), step):
            # not inside a written sign, unless it is longer than a step
            place.append(next((q for q in range(p, p - step, -1) if q > a and not _inside(text, q)), p))
            penalty.append(PENALTY["hard"])
    at, first = np.unique(np.array(place), return_index=True)
    return at, np.array(penalty)[first]


def _inside(text: str, at: int) -> bool:
    return bool(unicodedata.combining(text[at])) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"


def overlap_starts(text: str, at: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each cut begins: ``overlap`` characters before it, or up to SLACK fewer to begin with a word."""
    starts = np.maximum(at - overlap, 0)
    space = np.array([c.isspace() for c in text], bool)
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    after = np.searchsorted(begins, starts)
    word = begins[np.minimum(after, len(begins) - 1)] if len(begins) else np.full(len(at), -1)
    good = (word >= starts) & (word <= starts + int(overlap * SLACK)) & (word < at)
    return np.where(good, word, starts)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; a text within the limit is one piece, an empty one none.

    Every piece holds at most ``limit`` characters, its first ``overlap`` of them repeated from the piece before. The
    pieces without these are the text again.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []
    at, penalty = candidates(text, limit, overlap)
    start = overlap_starts(text, at, overlap)
    # place 0 of these arrays is the beginning of the text
    at, penalty, start = np.concatenate([[0], at]), np.concatenate([[0.0], penalty]), np.concatenate([[0], start])
    start = np.maximum.accumulate(start)
    pieces = int(np.ceil((len(text) - overlap) / (limit - overlap)))
    even = len(text) / pieces
    low = np.searchsorted(start, at - limit)
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    for j in range(1, len(at)):
        a = low[j]
        cost = best[a:j] + IMBALANCE * ((at[j] - at[a:j]) / even - 1) ** 2
        k = int(cost.argmin())
        best[j], back[j] = cost[k] + penalty[j] + PIECE, a + k
    cuts, j = [], len(at) - 1
    while j:
        cuts.append((int(start[back[j]]), int(at[j]), int(at[back[j]] - start[back[j]])))
        j = back[j]
    return cuts[::-1]


def split_texts(df: DataFrame, text: Column, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """keys, piece, pieces, start, end, overlap, nospace and, if wanted, the piece's text, for each text of each row.

    nospace: the text has more than ``limit`` characters in a row without white space, so that hard cuts can't be
    avoided. Null and empty texts give no rows; repeated rows give their pieces each.
    """
    own = "piece INT, pieces INT, start INT, end INT, overlap INT, nospace BOOLEAN" + ", text STRING" * with_text
    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(own).fields])
    arrow = to_arrow_schema(schema)
    run_on = re.compile(rf"\S{{{limit + 1}}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source: list[int] = []
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(len(keys))):
                value = value.as_py()
                cuts = split(value, limit, overlap) if value else []
                nospace = len(cuts) > 1 and run_on.search(value) is not None
                for n, (a, b, o) in enumerate(cuts):
                    source.append(i)
                    rows.append((n, len(cuts), a, b, o, nospace, *([value[a:b]] if with_text else [])))
            if rows:
                at = pa.array(source, pa.int64())
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[len(keys) :])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *columns], schema=arrow)

    return df.select(*keys, text.alias("__text")).where("__text is not null").mapInArrow(run, schema)


def oversized(messages: DataFrame, conversations: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of all message contents and conversation summaries longer than ``limit``: origin, item_key, then as split_texts."""
    def long(df: DataFrame, origin: str, key: str, text: str) -> DataFrame:
        return df.where(F.length(text) > limit).select(F.lit(origin).alias("origin"), F.col(key).alias("item_key"), F.col(text).alias("value"))

    both = long(messages, "message", "id", "content").unionByName(long(conversations, "summary", "id", "summary"))
    return split_texts(both, F.col("value"), ["origin", "item_key"], limit, overlap, with_text)
