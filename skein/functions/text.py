"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.vocab import NEGATIONS, NOTE_FOLDERS, REPLACING, STOP_WORDS


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case ASCII words of at least two characters without stop words; null gives null."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop_words))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def spaced(words_: Column) -> Column:
    """Words with two spaces between them and around all, so that phrases can be counted by replacing them."""
    return F.concat(F.lit("  "), F.array_join(words_, "  "), F.lit("  "))


def phrase_count(spaced_: Column, phrase: str) -> Column:
    """How often a phrase comes in ``spaced`` text, whole words only."""
    sought = " " + "  ".join(phrase.replace("/", " ").split()) + " "
    return F.floor((F.length(spaced_) - F.length(F.replace(spaced_, F.lit(sought), F.lit("")))) / len(sought)).cast("int")


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether the text holds any of the substrings, without regard to case."""
    low = F.lower(text)
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k.lower()))
    return found


def domains(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """All domains of which the text holds a substring, in order."""
    return F.filter(F.array(*(F.when(contains_any(text, ks), F.lit(d)) for d, ks in vocabulary.items())), lambda d: d.isNotNull())


def first_domain(text: Column, vocabulary: dict[str, list[str]], other: str) -> Column:
    """The first domain of which the text holds a substring, else ``other``."""
    out = F.lit(other)
    for d, ks in reversed(vocabulary.items()):
        out = F.when(contains_any(text, ks), d).otherwise(out)
    return out


def note_type(stated: Column, path: Column) -> Column:
    """The stated type, else the type of the first fitting directory in the path, else 'note'."""
    parts = F.split(F.lower(path), "/")
    out = F.lit("note")
    for kind, folders in reversed(NOTE_FOLDERS.items()):
        out = F.when(F.arrays_overlap(parts, _strings(folders)), kind).otherwise(out)
    return F.coalesce(F.nullif(stated, F.lit("")), out)


def negation_flags(text: Column) -> list[Column]:
    """(positive, negative) flags of each pattern pair, eight columns p0, n0, ...; null text gives null."""
    # the reference's word characters, spaces and case are those of Unicode; Java's \b differs from them by version
    # a letter beyond 16 bits in the class makes Java look behind by whole code points
    letter = "[\\p{L}\\p{N}_\U0001d400]"
    # every border of the patterns has a letter beside it, which is cheaper to look for than the border
    start = lambda p: re.sub(r"\\b(\w)", lambda m: f"{m[1]}(?<!{letter}{m[1]})", p)
    own = lambda p: "(?iU)" + start(p).replace(r"\b", f"(?!{letter})")
    return [text.rlike(own(p)).alias(f"{s}{i}") for i, pair in enumerate(NEGATIONS) for s, p in zip("pn", pair)]


def contradicts(flags_a: list[Column], flags_b: list[Column]) -> Column:
    """Whether one of two statements negates what the other or itself asserts, by their flags in the order of negation_flags."""
    out = F.lit(False)
    for i in range(0, len(flags_a), 2):
        out = out | ((flags_a[i + 1] != flags_b[i + 1]) & (flags_a[i] | flags_b[i]))
    return out


def replaces(text: Column) -> Column:
    """Whether a statement says that it replaces an older one."""
    return contains_any(text, REPLACING)


def front_matter(text: Column) -> Column:
    """The lines 'key: value' between leading '---' and the next line that starts with it, as MAP<STRING,STRING>; the last
    of equal keys counts. Empty without closed front matter; null for null."""
    end = F.locate("\n---", text, 4)
    inside = F.when(text.startswith("---") & (end > 0), F.substring(text, F.lit(4), end - 4)).otherwise("")
    lines = F.filter(F.split(inside, "\n"), lambda x: F.contains(x, F.lit(":")))
    bare = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(bare(F.substring_index(x, ":", 1)).alias("key"), bare(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value"))))


def body(text: Column) -> Column:
    """The text after its front matter, trimmed; all of it if there is none."""
    end = F.locate("\n---", text, 4)
    return F.when(text.startswith("---") & (end > 0), F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\s+|\s+$", "")).otherwise(text)


def snippet(text: Column, size: int = 220) -> Column:
    """Non-blank lines in one, cut at the last space before ``size`` with an ellipsis."""
    line = F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), " ")
    return F.when(F.length(line) <= size, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, size), r" [^ ]*$", ""), F.lit("…")))


def slug(text: Column, words_: int = 10, size: int = 64) -> Column:
    """The first ASCII words joined by '-', cut to ``size`` without a trailing '-'."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.regexp_replace(F.substring(F.array_join(F.slice(found, 1, words_), "-"), 1, size), "-+$", "")


def file_name(title: Column, size: int = 200) -> Column:
    """A title as a file name: without reserved characters, trimmed and cut."""
    return F.substring(F.trim(F.translate(title, '<>:"/\\|?*', "")), 1, size)


def short_id(*parts: Column, size: int = 12) -> Column:
    """A deterministic id of the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
