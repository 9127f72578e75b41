"""Problem 5: spellings of the names of persons and organisations, and which of them mean the same one.

Every name is taken apart into a stem (a family name, or an organisation's own word) and a rest (a given name, a trade),
in every order its tokens allow; names of more words are read with every word as stem or rest, and the other words stay
part of the name. Misspelt tokens are found by the trie join of ``tries``; a rest that is an initial, an
abbreviation, a nickname or a misspelling stands for a full one that its stem is known with, if only one fits. Two ids
mean the same if they have the same words in any order: so relatives and sister companies stay apart, and an initial that
fits several relatives links to none. A person's name without a middle name stands for the only fuller one there is.

Words of one or two letters have no misspellings: an edit makes them any other short word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.canonical import canonical_array
from skein.llm.tries import neighbours
from skein.session import checkpoint

# Words around a name that don't belong to it.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "herr", "frau", "mme", "mlle", "sr", "sra"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "esq"}
LEGAL = {"the", "and", "inc", "incorporated", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "mbh", "gesellschaft", "sa", "ag", "kg", "llc", "llp", "plc", "sociedad", "societe", "anonima", "anonyme", "bv", "nv", "oy", "ab"}
_NOTE = re.compile(r"\([^)]*\)|\s[-–—|]\s.*$")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_JOINT = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})")


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def tokens(name: str) -> list[tuple[str, bool]]:
    """(token in lower case, whether a point with a space or the end after it marks it as cut short)."""
    out = []
    for m in _TOKEN.finditer(name):
        after = name[m.end() : m.end() + 2]
        token = m.group().casefold().replace("'", "").replace("’", "")
        out.append((token, after[:1] == "." and (after[1:] in ("", " ", ",") or len(token) == 1)))
    return out


def person(name: str, given: set[str]) -> list[tuple[str, str, str, str]]:
    """(stem, rest, kind, others) that a person's name may be read as; kind: full, initial, short (cut off), glued (user name),
    none; others: the remaining whole words in order, for full names."""
    found = [t for t in tokens(_NOTE.sub(" ", name)) if t[0] not in TITLES and t[0] not in SUFFIXES and not t[0].isdigit()]
    whole = [t for t, short in found if len(t) > 1 and not (short and len(t) <= 4 and t not in given) and not (short and len(t) <= 3)]
    parts = [t for t, short in found if t not in whole]
    if len(whole) >= 2:
        return full_readings(whole, given)
    if not whole:
        return []
    stem = whole[0]
    if parts:
        return [(stem, parts[0], "initial" if len(parts[0]) == 1 else "short", "")]
    own = [(stem, "", "none", "")]
    if len(stem) > 5:
        own += [(stem[1:], stem[0], "glued", ""), (stem[:-1], stem[-1], "glued", "")]
    return own


def full_readings(words: list[str], given: set[str]) -> list[tuple[str, str, str, str]]:
    """Every pair of two words as stem and rest; where some words are given names and some are not, those are the rests.

    Of names of more than MOST_WORDS words the first and last word take turns, as all pairs would grow with their square.
    """
    names = [i for i, w in enumerate(words) if w in given]
    other = [i for i, w in enumerate(words) if w not in given]
    if len(words) > MOST_WORDS:
        pairs = [(len(words) - 1, 0), (0, len(words) - 1)]
    elif names and other:
        pairs = [(i, j) for i in other for j in names]
    else:
        pairs = [(i, j) for i in reversed(range(len(words))) for j in range(len(words)) if i != j]
    return [(words[i], words[j], "full", " ".join(sorted(w for k, w in enumerate(words) if k not in (i, j)))) for i, j in pairs]


#: Words of a name of which all pairs are read.
MOST_WORDS = 8


def organisation(name: str, given: set[str]) -> list[tuple[str, str, str, str]]:
    """(stem, rest, kind, others) that an organisation's name may be read as."""
    found = [t for t, _ in tokens(_JOINT.sub(" ", _NOTE.sub(" ", name))) if len(t) > 1 and t not in LEGAL]
    if len(found) >= 2:
        return full_readings(found, set())
    return [(found[0], "", "none", "")] if found else []


READ = {"person": person, "organization": organisation}


def readings(entities: DataFrame, given: set[str], listed: set[str]) -> DataFrame:
    """(id, type, stem, rest, kind, others, given) of every name and alias; given are the lexicon's given names and nicknames,
    listed those that are right as they are, and the column given says whether the rest is one of these."""
    kind = F.lower(F.trim("entity_type"))
    named = entities.where(F.col("id").isNotNull() & kind.isin(*READ)).select("id", kind.alias("type"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    named = named.where("name is not null and trim(name) != ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, kind_, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), canonical_array(batch.column(2)).to_pylist()):
                out += [(i, kind_, *r, r[1] in listed) for r in READ[kind_](plain(name), given)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    schema = pa.schema([*((c, pa.string()) for c in ("id", "type", "stem", "rest", "kind", "others")), ("given", pa.bool_())])
    return named.mapInArrow(run, "id STRING, type STRING, stem STRING, rest STRING, kind STRING, others STRING, given BOOLEAN").distinct()


def lexicon_names(lexicon: DataFrame) -> tuple[set[str], set[str], list[tuple[str, str]]]:
    """(given names, nicknames, (nickname, given name) pairs), in lower case. The lexicon is a fixed list, checked to be small."""
    rows = lexicon.limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} names")
    low = lambda x: plain(x).casefold()
    pairs = [(low(r.name), low(r.formal)) for r in rows if r.kind == "nickname" and r.name and r.formal]
    full = {low(r.name) for r in rows if r.kind == "given" and r.name} | {f for _, f in pairs}
    return full, {n for n, _ in pairs} - full, pairs


MAX_LEXICON = 100_000


def same_names(entities: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, type, key): one row per id; ids of one key mean the same person or organisation.

    Ids without a readable name, and those whose reading fits several, are left out. Repeated rows count once.
    """
    spark = entities.sparkSession
    given, nick, pairs = lexicon_names(lexicon)
    read = checkpoint(readings(entities, given | nick, given))
    words = read.select("type", F.explode(F.array("stem", "rest")).alias("word"), "id", "kind").where("length(word) > 2 and kind != 'glued'")
    count = words.groupBy("type", "word").agg(F.count_distinct("id").alias("n"))
    edges = checkpoint(neighbours(words, "type", "word").withColumnRenamed("group", "type"))
    # the more frequent spelling of two is the right one; given names of the lexicon are right as they are
    weight = count.select("type", F.col("word").alias("near"), F.col("n").alias("m"))
    sure = read.where("type = 'person' and given").select("type", F.col("rest").alias("word")).distinct()
    best = edges.join(weight, ["type", "near"]).join(count, ["type", "word"]).where("(m > n or (m = n and near > word))").groupBy("type", "word").agg(F.max_by("near", F.struct("m", "near")).alias("right"))
    right = checkpoint(best.join(sure, ["type", "word"], "left_anti"))
    stems = right.select("type", F.col("word").alias("stem"), F.col("right").alias("stem_right"))
    own = read.join(stems, ["type", "stem"], "left").withColumn("stem", F.coalesce("stem_right", "stem")).drop("stem_right")
    known = own.where("kind != 'glued'").select("type", "stem").distinct()
    own = own.join(known, ["type", "stem"], "left_semi")
    uses = checkpoint(own.groupBy("type", "stem", "rest", "kind").agg(F.count_distinct("id").alias("n"), F.bool_or("given").alias("given")))
    nicknames = _nicknames(spark, own, bool(given), pairs)
    resolved = checkpoint(_resolve(uses, edges, right, nicknames))
    keyed = _with_middle(own.drop("given").join(resolved, ["type", "stem", "rest", "kind"]), right)
    key = F.concat_ws("|", "type", F.array_join(F.array_sort(F.concat(F.array("stem", "full"), F.filter(F.split("others", " "), lambda w: w != ""))), "|"))
    votes = keyed.groupBy("id", "type", key.alias("key")).agg(F.max("sure").alias("sure"), F.count("*").alias("votes"))
    return votes.groupBy("id").agg(F.max_by(F.struct("type", "key", "sure"), F.struct("sure", "votes", "key")).alias("b")).select("id", "b.type", "b.key")


def _with_middle(keyed: DataFrame, right: DataFrame) -> DataFrame:
    """``keyed`` with its other words rightly spelt, and those of a person's name without any, if only one fuller name fits."""
    more = keyed.where("others != ''").select("type", "others").distinct()
    each = more.select("type", "others", F.explode(F.split("others", " ")).alias("word")).join(right, ["type", "word"], "left")
    spelt = each.groupBy("type", "others").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("right", "word"))), " ").alias("spelt"))
    keyed = keyed.join(spelt, ["type", "others"], "left").withColumn("others", F.coalesce("spelt", "others")).drop("spelt")
    fuller = keyed.where("type = 'person' and others != ''").groupBy("type", "stem", "full").agg(F.min("others").alias("low"), F.max("others").alias("high")).where("low = high")
    filled = keyed.join(fuller.select("type", "stem", "full", "low"), ["type", "stem", "full"], "left")
    return filled.withColumn("others", F.when((F.col("others") == "") & F.col("low").isNotNull(), F.col("low")).otherwise(F.col("others"))).drop("low")


def _nicknames(spark, own: DataFrame, listed: bool, pairs: list[tuple[str, str]]) -> DataFrame:
    """(type, rest, full): the lexicon's nicknames, and those that ids of two stems at least use beside a given name."""
    known = spark.createDataFrame(pairs or [("", "")], "rest STRING, full STRING").select(F.lit("person").alias("type"), "rest", "full")
    if not listed:
        return known
    named = own.where("type = 'person' and kind = 'full' and others = ''").select("id", "stem", "rest", "given")
    beside = named.where("not given").drop("given").join(named.where("given").select("id", "stem", F.col("rest").alias("full")), ["id", "stem"])
    learnt = beside.groupBy("rest", "full").agg(F.count_distinct("stem").alias("n")).where("n >= 2").select(F.lit("person").alias("type"), "rest", "full")
    return checkpoint(known.unionByName(learnt).distinct())


def _resolve(uses: DataFrame, edges: DataFrame, right: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(type, stem, rest, kind, full, sure): the full rest that each rest of a stem stands for. sure: 3 if it is a given name
    of the lexicon, 2 if another full one, 1 if it only agrees with itself."""
    wrong = right.select("type", F.col("word").alias("rest"), F.lit(True).alias("wrong"))
    full = uses.where("kind = 'full'").groupBy("type", "stem", "rest").agg(F.sum("n").alias("n"), F.bool_or("given").alias("given"))
    full = full.join(wrong, ["type", "rest"], "left").join(nicknames.select("type", "rest", F.lit(True).alias("nick")).distinct(), ["type", "rest"], "left")
    sound = full.where(F.col("given") | (F.col("wrong").isNull() & F.col("nick").isNull()))
    sound = checkpoint(sound.select("type", "stem", F.col("rest").alias("full"), F.col("n").alias("full_n"), F.col("given").alias("full_given")))
    asked = uses.where("not (kind = 'full' and given and type = 'person')").select("type", "stem", "rest", "kind", "n")
    # initials, cut-off names and shortened words: those that begin with the same letter
    by_letter = asked.withColumn("letter", F.substring("rest", 1, 1)).join(sound.withColumn("letter", F.substring("full", 1, 1)), ["type", "stem", "letter"])
    letters = F.split("rest", "")
    # the pattern r.*e.*s.*t finds the letters in order; tokens hold letters and digits only
    in_order = F.rlike("full", F.concat(F.lit("^"), F.array_join(letters, ".*")))
    short = F.length("rest") < F.length("full")
    fits = F.when(F.col("kind").isin("initial", "glued"), F.lit(True)).when(F.col("kind") == "short", F.col("full").startswith(F.col("rest")) | in_order).when(F.col("kind") == "full", short & in_order & (F.length("rest") > 1))
    out = ["type", "stem", "rest", "kind", "full", "full_given"]
    found = by_letter.where(fits).select(*out)
    # nicknames and misspellings
    found = found.unionByName(asked.where("kind in ('full', 'short')").join(nicknames, ["type", "rest"]).join(sound.drop("full_n"), ["type", "stem", "full"]).select(*out))
    misspelt = asked.where("kind = 'full'").join(edges.select("type", F.col("word").alias("rest"), F.col("near").alias("full")), ["type", "rest"])
    found = found.unionByName(misspelt.join(sound, ["type", "stem", "full"]).where("full_n >= n").select(*out))
    # a stem alone stands for the only full name it has
    alone = asked.where("kind = 'none'").join(sound, ["type", "stem"]).select(*out)
    found = checkpoint(found.unionByName(alone).where("rest != full").distinct())
    # a full form that is itself short for another one doesn't count beside that one
    lesser = found.where("kind = 'full'").select("type", "stem", F.col("rest").alias("full")).distinct()
    found = found.join(lesser, ["type", "stem", "full"], "left_anti")
    one = found.groupBy("type", "stem", "rest", "kind").agg(F.count("*").alias("options"), F.min("full").alias("full"), F.bool_or("full_given").alias("full_given"))
    own = uses.join(one, ["type", "stem", "rest", "kind"], "left")
    taken = F.when(F.col("options") == 1, F.col("full")).when(F.col("options").isNull(), F.col("rest"))
    lexical = (F.col("type") == "person") & F.when(F.col("options") == 1, F.col("full_given")).otherwise(F.col("given"))
    sure = F.when(lexical, 3).when((F.col("options") == 1) | (F.col("kind") == "full"), 2).otherwise(1)
    lone = (F.col("kind") == "glued") & F.col("options").isNull()
    return own.select("type", "stem", "rest", "kind", taken.alias("full"), sure.alias("sure"), lone.alias("lone")).where("full is not null and not lone").drop("lone")


def same_pairs(entities: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids that mean the same one."""
    own = checkpoint(same_names(entities, lexicon).select("id", "key"))
    a, b = (own.select("key", F.col("id").alias(f"id_{x}")) for x in "ab")
    return a.join(b, "key").where("id_a < id_b").select("id_a", "id_b")
