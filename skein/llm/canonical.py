"""Problem 10: one consistent form of visually identical text.

Arrow string buffers become one numpy array of code points a batch; lookup tables expand every code point (full-width
forms, joined letters, special spaces and hyphens, look-alike letters, canonical decompositions, nothing for invisible
ones), marks are put in canonical order and composed again, all vectorially, and the points go back as one buffer. There
is no string call per row.

What counts as the same: case, punctuation, visible accents and words are kept apart; super- and subscripts, circled and
styled letters look different and are kept.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.session import checkpoint

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТУХЅІЈԚԜ" "асеорхуѕіјһԁԛԝӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονϲϳ" "օսհ" "ɡ",
    "ABEKMHOPCTYXSIJQW" "aceopxysijhdqwl" "ABEZHIKMNOPTYX" "ovcj" "ouh" "g",
))
# Hyphens that look like the plain one, and invisible characters that are not format characters.
PLAIN_HYPHENS = "‐‑﹣－"
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
#: Format characters that are drawn.
DRAWN_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Compatibility forms drawn just like their letters: joined letters, digraphs, Roman numerals, runs of points and marks.
JOINED = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x203C, 0x203C), (0x2047, 0x2049), (0x2160, 0x217F), (0xFB00, 0xFB4F)]
POINTS = sys.maxunicode + 1
#: Code points handled at once; bounds the memory of a Python worker, whatever the rows of a batch.
SLICE_POINTS = 1_000_000
_L, _V, _T, _S, _LN, _VN, _TN = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


def _expand(c: str) -> str:
    """What one character is replaced by, decomposed."""
    p = ord(c)
    kind = unicodedata.category(c)
    if (kind == "Cf" and p not in DRAWN_FORMATS) or p in INVISIBLE:
        return ""
    if kind == "Zs":
        return " "
    if c in PLAIN_HYPHENS:
        return "-"
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    tag, _, rest = unicodedata.decomposition(c).rpartition("> ")
    if rest and (not tag or tag in ("<wide", "<narrow", "<noBreak") or (tag == "<compat" and any(a <= p <= b for a, b in JOINED))):
        return "".join(_expand(chr(int(x, 16))) for x in rest.split())
    return c


@cache
def tables() -> dict[str, np.ndarray]:
    """length, start and flat hold the expansion of each code point; ccc its combining class; pair, whole the compositions."""
    length, start = np.ones(POINTS, np.uint8), np.arange(POINTS, dtype=np.int32)
    flat, extra = np.arange(POINTS, dtype=np.uint32), []
    ccc = np.zeros(POINTS, np.uint8)
    pair = []
    for p in (*range(0x80, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)):  # no other code points are assigned characters
        c = chr(p)
        ccc[p] = unicodedata.combining(c)
        full = _expand(c)
        if full != c:
            length[p], start[p] = len(full), POINTS + len(extra)
            extra += map(ord, full)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and "<" not in parts[0] and unicodedata.normalize("NFC", c) == c:
            pair.append((int(parts[0], 16) << 21 | int(parts[1], 16), p))
    pair.sort()
    keys, whole = np.array(pair, np.int64).T
    return {"length": length, "start": start, "flat": np.concatenate([flat, np.array(extra, np.uint32)]), "ccc": ccc, "pair": keys, "whole": whole.astype(np.uint32)}


def to_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after each other, and the offsets of the texts among them; null texts are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets - offsets[0]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets - offsets[0]]


def from_points(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[offsets]
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))


def gather(points: np.ndarray, offsets: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every point replaced by its entry of a table, of any length."""
    n = length[points].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start[points] - ends[:-1], n) + np.arange(ends[-1])
    return flat[at], ends[offsets]


def _keep(points: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _pairs(a: np.ndarray, b: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Composition of each pair, 0 if there is none."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    found = np.where(t["pair"][at] == key, t["whole"][at], 0)
    a, b = a.astype(np.int64), b.astype(np.int64)
    lead = (a >= _L) & (a < _L + _LN) & (b >= _V) & (b < _V + _VN)
    tail = (a >= _S) & (a < _S + _LN * _VN * _TN) & ((a - _S) % _TN == 0) & (b > _T) & (b < _T + _TN)
    return np.where(lead, _S + ((a - _L) * _VN + b - _V) * _TN, np.where(tail, a + b - _T, found)).astype(np.uint32)


def compose(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of decomposed points."""
    t = tables()
    ccc = t["ccc"][points]
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    mark = ccc > 0
    if mark.any():
        group = np.cumsum(~mark | first) - 1
        at = np.flatnonzero(mark)
        order = np.lexsort((ccc[at], group[at]))
        points = points.copy()
        points[at], ccc[at] = points[at][order], ccc[at][order]
        head = np.flatnonzero(~mark | first)
        has_starter = ~mark[head]
        nth = at - head[group[at]]
        kept = np.ones(len(points), bool)
        blocked = np.zeros(len(head), np.uint8)
        for k in range(1, int(nth.max()) + 1 if len(nth) else 0):
            now = at[nth == k]
            now = now[has_starter[group[now]]]
            g = group[now]
            whole = np.where(blocked[g] < ccc[now], _pairs(points[head[g]], points[now], t), 0)
            hit = whole > 0
            points[head[g[hit]]] = whole[hit]
            kept[now[hit]] = False
            blocked[g[~hit]] = ccc[now[~hit]]
        points, offsets = _keep(points, offsets, kept)
    while len(points) > 1:
        # two starters side by side: Hangul syllables and a few vowel signs
        first = np.zeros(len(points) + 1, bool)
        first[offsets] = True
        second = t["ccc"][points[1:]] == 0
        candidates = np.flatnonzero(second & ~first[1:-1] & (points[1:] >= 0x0900) & (points[:-1] >= 0x0900))
        whole = _pairs(points[candidates], points[candidates + 1], t)
        candidates, whole = candidates[whole > 0], whole[whole > 0]
        if not len(candidates):
            break
        alone = np.concatenate([[True], np.diff(candidates) > 1])
        candidates, whole = candidates[alone], whole[alone]
        points = points.copy()
        points[candidates] = whole
        kept = np.ones(len(points), bool)
        kept[candidates + 1] = False
        points, offsets = _keep(points, offsets, kept)
    return points, offsets


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(points) or points.max() < 0x80:
        return points, offsets
    t = tables()
    return compose(*gather(points, offsets, t["length"], t["start"], t["flat"]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_POINTS characters; a longer text is a range of its own."""
    if not len(texts):
        return
    sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_POINTS, "right")))
        yield at, to
        at = to


def canonical_array(texts: pa.Array) -> pa.Array:
    """Canonical form of each text; null stays null, empty stays empty."""
    chunks = [pa.array([], pa.large_string())]
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        form = from_points(*canonical_points(*to_points(pc.fill_null(part, ""))))
        chunks.append(pc.if_else(part.is_null(), pa.scalar(None, pa.large_string()), form) if part.null_count else form)
    return pa.concat_arrays(chunks)


def canonical(df: DataFrame, text: str = "text", out: str = "canonical", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the canonical form of ``text`` in ``out``, which replaces a column of that name.

    Null gives null, empty gives empty; rows are kept as they are, repeated ones too. A text of any length is taken whole.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = canonical_array(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], form.cast(arrow.field(len(keep)).type)], schema=arrow)

    quoted = [F.col(f"`{c}`") for c in keep]
    return df.select(*quoted, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_key, text_key): one row per document. class_key is a hash of the canonical form, text_key of the text as stored.

    Documents of one class_key look the same. Null texts are in no class and give no row.
    """
    forms = canonical(documents.where(F.col(text).isNotNull()).select(key, F.unhex(F.sha2(text, 256)).alias("text_key"), text), text, "form", [key, "text_key"])
    return forms.select(key, F.unhex(F.sha2("form", 256)).alias("class_key"), "text_key")


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(<key>_a, <key>_b), a < b: pairs whose texts differ as stored but look the same.

    Classes of one stored text, however many copies it has, are dropped before any join. Then different texts of a class
    meet, and only then the documents of both: no more rows arise than come out.
    """
    # the texts are read once; what is kept of them is three short columns
    rows = checkpoint(look_alike_classes(documents, key, text)).distinct()
    mixed = rows.groupBy("class_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low != high").select("class_key")
    own = rows.join(mixed, "class_key", "left_semi")
    forms = own.select("class_key", "text_key").distinct()
    a, b = (forms.select("class_key", F.col("text_key").alias(f"text_{x}")) for x in "ab")
    differ = a.join(b, "class_key").where("text_a < text_b").select("text_a", "text_b")
    first, second = (own.select(F.col("text_key").alias(f"text_{x}"), F.col(key).alias(f"key_{x}")) for x in "ab")
    pairs = differ.join(first, "text_a").join(second, "text_b").where("key_a != key_b")
    return pairs.select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b")).distinct()
