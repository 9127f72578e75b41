"""Problem 3: mentions of people's emails, phones, id numbers, street addresses and names in free text, and their redaction.

Generators of high recall propose spans that may overlap; for each kind, gradient-boosted trees score a span by its format
and its context; calibrated thresholds and the scores select among overlapping spans. The trees are trained on the driver
from texts written by a seeded generator (``TRAINING_TEXTS`` of them, a fixed bound), in which every mention is known;
given names come from the lexicon and from the corpus: words that go before many different rare words.
"""

from __future__ import annotations

import base64
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.guards import once
from skein.functions.jsons import readable
from skein.llm.boosting import BoostedTrees
from skein.llm.canonical import slices
from skein.llm.mixing import TOKENIZER, tokenizer_path
from skein.llm.names import MAX_LEXICON
from skein.session import checkpoint

KINDS = ("email", "phone", "id_number", "address", "name")
#: Texts written to train the trees on, and the seed they are written from.
TRAINING_TEXTS, SEED = 9000, 7

#: Digits without which no phone or id number is proposed.
LEAST_DIGITS = 6

# Forms of address, words of streets, spoken digits.
TITLES = ["mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "frau", "herr", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr", "sra", "don", "doña"]
STREETS = ["street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "way", "court", "ct", "square", "sq", "drive", "dr", "boulevard", "blvd", "place", "pl", "terrace", "close", "crescent", "row", "hill", "parkway", "highway"]
DIGIT_WORDS = ["zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ][\w'’]*"
# Patterns start at the first sign of a run and never give back what they took, so that a run of any length costs its length.
_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%-]++"
    r"(?:@[\w-]++(?:\.[\w-]++)+"
    r"|\s?[(\[{<]\s?(?:at|AT)\s?[)\]}>]\s?[\w-]++(?:\s?(?:[(\[{<]\s?(?:dot|DOT)\s?[)\]}>]|\.)\s?[\w-]++)+"
    r"| (?:at|AT) [\w-]++(?: (?:dot|DOT) [\w-]++)+)"
    r"|(?<![\w@])@\w+"
)
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{1,3}[ -]?\d(?:[\d .\-/]{0,40}\d)?(?:[ -]?[A-Z]\b)?"
    r"|(?:\+|\(\+?)?\d(?:[\d ().\-/]{0,40}\d)?(?:-?[A-Za-z]\b)?(?:\s?(?:ext|x)\.?\s?\d{1,5})?"
)
_SPOKEN = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})(?:[ -](?:{'|'.join(DIGIT_WORDS)})){{2,}}\b", re.I)
_ADDRESS = re.compile(
    rf"(?P<box>\b(?:P\.?\s?O\.?\s?Box|Post(?:al)? Box|Postfach|Apartado(?: de correos)?|Boîte postale|BP)\s+\d+)"
    rf"|(?P<english>\b\d{{1,5}}[A-Za-z]?,? (?:{_CAPITAL} ){{1,3}}(?:{'|'.join(s.title() for s in STREETS)})\b\.?)"
    rf"|(?P<french>\b\d{{1,5}}(?: bis| ter| quater)?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|passage)\s+(?:d[eu]s?\s+|de la\s+|d['’]|la\s+|le\s+|les\s+|l['’])?[^\W\d_][\w'’ -]{{0,40}})"
    rf"|(?P<german>(?<![\w-])[^\W\d_][\w-]{{0,40}}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)\s+\d{{1,5}}\s?[a-z]?\b)"
    rf"|(?P<spanish>(?<!\w)(?:C/|Calle|Avda\.?|Avenida|Plaza|Paseo|Camino)\s+[^\W\d_][^\d\n,;]{{0,40}},?\s*\d{{1,5}})",
)
_CITY = re.compile(rf"(?:,? (?:Apt|Suite|Unit|Flat)\.? \w+|, \d+º(?: [A-Z]\b)?)?(?:, (?:\d{{4,5}} )?{_CAPITAL}(?:[ -]{_CAPITAL})?| \d{{4,5}} {_CAPITAL})?")
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.?\s+(?=[^\W\d_])", re.I)
_WORDS = re.compile(_WORD)
_TITLE_WORDS = frozenset(TITLES)
# What a pattern can't match without; a text that holds none of it needn't be looked through. Each part of a pattern has its
# own sign: literal text of that part, or for spoken addresses the sub-pattern itself.
_BRACKETED_AT = re.compile(r"[(\[{<]\s?(?:at|AT)\s?[)\]}>]")
_STREET_SIGNS = [
    *(f" {s.title()}" for s in STREETS),
    "Box", "Postfach", "Apartado", "Boîte postale", "BP",
    "rue", "avenue", "av.", "boulevard", "bd", "place", "chemin", "allée", "impasse", "quai", "route", "cours", "passage",
    "straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring",
    "C/", "Calle", "Avda", "Avenida", "Plaza", "Paseo", "Camino",
]
_SPOKEN_SIGNS = [f"{a}{by}{b}" for a in DIGIT_WORDS for b in DIGIT_WORDS for by in " -"]


def _any_of(signs: list[str]):
    """Whether a text holds any of the signs, by one automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for s in signs:
        automaton.add_word(s, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


@cache
def _signs() -> tuple:
    return _any_of(_STREET_SIGNS), _any_of(_SPOKEN_SIGNS)


def may_hold_email(text: str) -> bool:
    return "@" in text or " dot " in text or " DOT " in text or _BRACKETED_AT.search(text) is not None


def may_hold_number(text: str) -> bool:
    """Whether there are as many digits as a number needs; digits of other scripts count as enough."""
    return not text.isascii() or sum(map(text.count, "0123456789")) >= LEAST_DIGITS


def may_hold_address(text: str) -> bool:
    return _signs()[0](text)


def may_hold_spoken(text: str) -> bool:
    # some letters are no ASCII ones and yet fold to them without regard to case
    return not text.isascii() or _signs()[1](text.lower())


@lru_cache(200_000)
def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Rarity:
    """How many pieces a public tokenizer's vocabulary needs for a word: common words are one piece, invented ones many."""

    def __init__(self, path: str):
        self.path = path
        self._known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        word = word.casefold()
        if word not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            ranks, raw, at, n = _ranks(self.path), b" " + word.encode(), 0, 0
            while at < len(raw):
                to = len(raw)
                while to > at + 1 and raw[at:to] not in ranks:
                    to -= 1
                at, n = to, n + 1
            self._known[word] = n
        return self._known[word]


class Span:
    __slots__ = ("kind", "start", "end", "features")

    def __init__(self, kind: str, start: int, end: int, features: list[float]):
        self.kind, self.start, self.end, self.features = kind, start, end, features


def _cues(words: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{words})", re.I)


# Words near a mention that tell what it is.
PHONE_CUES = _cues("call|phone|tel|telephone|mobile|cell|fax|dial|ring|rang|text|line|number|nummer|appelez|au|unter|teléfono|móvil|llama")
ID_CUES = _cues("passport|ssn|social|id|identity|licen[cs]e|tax|nino|dni|nif|record|no|dossier|número|ausweis|steuer|personal|signed|bring|ficha|insurance")
OTHER_CUES = _cues("batch|ticket|req|commit|build|version|server|chunk|checksum|block|key|run|runs|tests|window|ratio|tokens|rows|line_no|error|warn|info|exit|code|order|invoice|isbn|pin|sku")
NAME_BEFORE = _cues("because|if|so|while|when|maybe|think|thinks|thanks|thank|hi|hello|dear|from|to|by|with|ask|asked|that|for|and|names|contact|owner|signed|cc|was|met|told|invite|letter|of|belongs|said|tell|see|regards|cheers|appelez|de|von|an|für|para|con|à")
NAME_AFTER = _cues("would|will|wrote|said|says|asked|argued|signed|found|thinks|and|or|who|about|on|at|is|was|has|agreed|called|sent|as|hat|a|dit|dijo|will|wants")
STOP_AFTER = _cues("the|a|an|all|every|each|this|that|these|those|your|my|its|any|no|more|up|off|down")


def _near(text: str, start: int, end: int, cues: re.Pattern, before: int = 24, after: int = 0) -> float:
    left = text[max(0, start - before) : start]
    return float(len(cues.findall(left))) + 2.0 * len(cues.findall(text[end : end + after]))


class Finder:
    """Proposes spans of all kinds in a text."""

    def __init__(self, given: frozenset[str], learnt: frozenset[str], path: str):
        self.given, self.learnt, self.rarity = given, learnt, Rarity(path)
        self._kinds: dict[str, int] = {}
        self._telling: set[str] = set()
        self.more: frozenset[str] = frozenset()

    def spans(self, text: str, own: frozenset[str] = frozenset(), sift: bool = True) -> list[Span]:
        """Candidates of all kinds. own: learnt given names beside the finder's; sift: look only for what the text may hold,
        which finds the same."""
        out = [Span("email", m.start(), m.end(), self.email(text, m)) for m in _EMAIL.finditer(text)] if not sift or may_hold_email(text) else []
        for m in _NUMBER.finditer(text) if not sift or may_hold_number(text) else ():
            raw = m.group()
            if len(raw) < LEAST_DIGITS or sum(map(str.isdigit, raw)) < LEAST_DIGITS:
                continue
            start, end = self.trimmed(text, m.start(), m.end())
            features = self.number(text, start, end)
            out += [Span("phone", start, end, features), Span("id_number", start, end, features)]
            # what stands before a phone's own first sign may belong to another word
            inner = re.search(r"[+(]?\d", text[start:end])
            if inner and inner.start():
                out.append(Span("phone", start + inner.start(), end, self.number(text, start + inner.start(), end)))
        for m in _SPOKEN.finditer(text) if not sift or may_hold_spoken(text) else ():
            out.append(Span("phone", m.start(), m.end(), self.spoken(text, m)))
        for m in _ADDRESS.finditer(text) if not sift or may_hold_address(text) else ():
            end = m.end()
            city = _CITY.match(text, end)
            out.append(Span("address", m.start(), city.end(), self.address(text, m, city.end() > end)))
        out += self.names(text, own)
        return out

    @staticmethod
    def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
        """Without a closing bracket that isn't opened."""
        while end > start and text[end - 1] in " .-/(":
            end -= 1
        if text[start] == "(" and ")" not in text[start:end]:
            start += 1
        return start, end

    def email(self, text: str, m: re.Match) -> list[float]:
        raw = m.group()
        local, _, domain = raw.partition("@")
        spoken = "@" not in raw
        tail = re.split(r"[.\s)\]]+", raw)[-1] or ""
        return [float(spoken), float(bool(local)) if not spoken else 1.0, float(len(raw)), float(raw.lower().count(".") + raw.lower().count("dot")), float(any(c.isdigit() for c in raw)), float(bool(re.search(r"[(\[{<]\s?at", raw, re.I))), float(" at " in raw.lower()), float(tail.isalpha()), float(len(tail)), float(m.start() > 0 and text[m.start() - 1] in "/:@"), float("dot" in raw.lower())]

    def number(self, text: str, start: int, end: int) -> list[float]:
        raw = text[start:end]
        ext = re.search(r"\s?(?:ext|x)\.?\s?\d+$", raw)
        core = raw[: ext.start()] if ext else raw
        groups = [len(g) for g in re.findall(r"\d+", core)]
        digits = sum(groups)
        before, after = re.match(r"[A-Z]*", core).end(), len(core) - len(core.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        left = text[start - 1] if start else " "
        right = text[end] if end < len(text) else " "
        lead = re.search(r"\d+", core).group()
        shape = [*groups[:6], *[0] * (6 - len(groups))]
        return [
            float(digits), float(len(groups)), *map(float, shape), float("+" in core), float("(" in core), float(core.count(".")), float(core.count("-")), float(core.count(" ")), float(core.count("/")),
            float(before), float(after), float(lead.startswith("0")), float(lead.startswith("00")), float(bool(ext)), float(left.isalnum() or left in "_#"), float(left in "-./:"), float(right.isalnum() or right == "_"), float(right in "-/:"),
            _near(text, start, end, PHONE_CUES, after=12), _near(text, start, end, ID_CUES, after=12), _near(text, start, end, OTHER_CUES, 16, 10), float(any(c.isalpha() and c.islower() for c in core)), 0.0,
        ]

    def spoken(self, text: str, m: re.Match) -> list[float]:
        n = len(re.split(r"[ -]", m.group()))
        features = self.number(text + " 0", len(text) + 1, len(text) + 2)
        features[0], features[1], features[-1] = float(n), 1.0, float(n)
        features[-5:-2] = [_near(text, m.start(), m.end(), PHONE_CUES, after=12), _near(text, m.start(), m.end(), ID_CUES, after=12), _near(text, m.start(), m.end(), OTHER_CUES, 16, 10)]
        return features

    def address(self, text: str, m: re.Match, city: bool) -> list[float]:
        kinds = ["box", "english", "french", "german", "spanish"]
        raw = m.group()
        return [*(float(m.lastgroup == k) for k in kinds), float(city), float(len(raw)), float(len(raw.split())), float(sum(w[:1].isupper() for w in raw.split())), float(m.start() > 0 and text[m.start() - 1].isalnum()), float(m.start() > 1 and text[m.start() - 1] in "-./:#")]

    # names

    def kind_of(self, word: str) -> int:
        """1 for a given name, 2 for a form of address, 0 else; kept for each spelling."""
        kind = self._kinds.get(word)
        if kind is None:
            if len(self._kinds) > 500_000:
                self._kinds.clear()
                self._telling.clear()
            kind = self._kinds[word] = 1 if plain(word) in self.given or plain(word) in self.learnt else 2 if word.casefold() in _TITLE_WORDS else 0
            if kind:
                self._telling.add(word)
        return kind

    def names(self, text: str, own: frozenset[str] = frozenset()) -> list[Span]:
        self.more = own
        found = _WORDS.findall(text)
        each = set(found)
        for word in each.difference(self._kinds):
            self.kind_of(word)
        if not own and self._telling.isdisjoint(each):
            return []
        kinds = [1 if own and plain(w) in own else self.kind_of(w) for w in found]
        if not any(kinds):
            return []
        out = []
        words = [(w, *m.span()) for w, m in zip(found, _WORDS.finditer(text))]
        for i, kind in enumerate(kinds):
            if kind != 1:
                continue
            _, start, _ = words[i]
            family = self._family_after(text, words, i)
            out.append(Span("name", start, self._end(words, i, family), self.name(text, words, i, i, family, 0)))
            if i and text[words[i - 1][2] : start] == ", ":
                out.append(Span("name", words[i - 1][1], words[i][2], self.name(text, words, i - 1, i, i - 1, 1)))
        if 2 not in kinds:
            return out
        starts = {s: i for i, (_, s, _) in enumerate(words)}
        for m in _TITLED.finditer(text):
            i = starts.get(m.end())
            if i is not None and m.end() < len(text):
                family = i if kinds[i] != 1 else self._family_after(text, words, i)
                out.append(Span("name", words[i][1], self._end(words, i, family), self.name(text, words, i, i, family, 2)))
        return out

    def _end(self, words: list, i: int, family: int | None) -> int:
        """End of a name: the family name belongs to it if it is written in the style of the given one, and is no common word."""
        own, other = words[i][0], words[family or i][0]
        same = own.isupper() == other.isupper() and own.islower() == other.islower()
        return words[family][2] if family is not None and family >= i and same and (other != other.lower() or self.rarity(other) > 2) else words[i][2]

    def _family_after(self, text: str, words: list, i: int) -> int | None:
        """The word after a given name, or after a given name and an initial, that may be the family name."""
        j = i + 1
        if j < len(words) and len(words[j][0]) == 1 and text[words[i][2] : words[j][1]].isspace() and j + 1 < len(words) and text[words[j][2] : words[j + 1][1]] in (". ", " "):
            return j + 1
        if j < len(words) and text[words[i][2] : words[j][1]] in (" ", "  ", "\xa0"):
            return j
        return None

    def name(self, text: str, words: list, first: int, given: int, family: int | None, form: int) -> list[float]:
        word, start, _ = words[first]
        own = words[given][0]
        other = words[family][0] if family is not None else ""
        last = max(given, family if family is not None else given)
        end = words[last][2]
        style = lambda w: 0.0 if not w else 1.0 if w[0].isupper() and w[1:].islower() else 2.0 if w.isupper() else 3.0 if w.islower() else 4.0
        left = text[max(0, start - 2) : start]
        begins = not left.strip() or left.strip()[-1:] in ".!?;:\n|" or "\n" in left
        after = text[end : end + 1]
        follow = words[last + 1][0] if last + 1 < len(words) and text[end : words[last + 1][1]] == " " else ""
        beside = other if family is not None and family > given else follow
        return [
            float(form == 0), float(form == 1), float(form == 2), style(own), style(other), float(plain(own) in self.given), float(plain(own) in self.learnt or plain(own) in self.more),
            float(self.rarity(other)) if other else 0.0, float(len(other)), float(self.rarity(own)), float(len(own)), float(begins), float(start == 0),
            float(left[-1:].isalnum() or left[-1:] in "_@/-.+"), float(left[-1:] in "\"'(<|=:"), float(after in ",!?." and bool(after)), float(after in "\"')>|/"), float(after == "_" or after == "@" or after == "-"),
            float(bool(STOP_AFTER.fullmatch(beside))) if beside else 0.0, float(bool(NAME_AFTER.fullmatch(beside))) if beside else 0.0, float(style(beside)), float(self.rarity(beside)) if beside else 0.0,
            min(1.0, _near(text, start, end, NAME_BEFORE, 10)), float(bool(follow) and bool(NAME_AFTER.fullmatch(follow))), float(style(follow)), float(style(own) == style(other)) if other else 0.0, float(plain(other) in self.given) if other else 0.0,
        ]


# Texts to train on: sentences with known mentions, and sentences with what only looks like one.

_SYLLABLES = ["bra", "dov", "el", "fen", "gri", "hol", "ik", "jor", "kla", "lun", "mor", "nek", "os", "pra", "quil", "rus", "ska", "thor", "um", "vel", "wex", "yar", "zan", "blo", "tri", "shu", "vra", "plo"]
_PLAIN = ["report", "folder", "archive", "table", "index", "meeting", "garden", "server", "budget", "notes", "parser", "exporter", "backup", "summary", "cache", "build", "chart", "lunch", "review", "list"]
_CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/0123456789"
_DOING = ["moved", "checked", "renamed", "filled", "sorted", "printed", "merged", "closed", "read", "split"]


class Writer:
    """Writes training texts; every mention's kind and start is known."""

    def __init__(self, given: list[str], seed: int = SEED):
        self.r = random.Random(seed)
        self.given = given or ["Anna", "Peter", "Laura", "Simon"]

    def family(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(2, 4))).title()

    def d(self, form: str) -> str:
        """The form with each 9 made a digit and each A a capital letter."""
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") if c == "A" else c for c in form)

    def name(self) -> tuple[str, str]:
        r = self.r
        g, f = r.choice(self.given).title(), self.family()
        form = r.random()
        if form < 0.12:
            text = f"{f}, {g}"
        elif form < 0.25:
            text = f"{g} {r.choice('ABCDEFGHJKLMNPRST')}. {f}"
        else:
            text = f"{g} {f}"
        style = r.random()
        return "name", text.upper() if style < 0.1 else text.lower() if style < 0.2 else text

    def email(self) -> tuple[str, str]:
        r = self.r
        g, f = r.choice(self.given).lower(), self.family().lower()
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}{r.randint(1, 99)}", f"{g}_{f}", f"{f}-{g}", f"{g}.{f}+{r.choice(_PLAIN)}"])
        host = [r.choice(_SYLLABLES) + r.choice(_SYLLABLES), r.choice(["org", "com", "example", "test", "invalid", "net"])]
        if r.random() < 0.4:
            host.insert(0, r.choice(["mail", "post", "team"]))
        at, dot = r.choice([("@", ".")] * 3 + [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", ".")])
        text = local + at + dot.join(host)
        return "email", text.upper() if r.random() < 0.1 else text

    def phone(self) -> tuple[str, str]:
        r = self.r
        if r.random() < 0.12:
            return "phone", " ".join(r.choice(DIGIT_WORDS) for _ in range(r.choice([7, 8, 10])))
        text = self.d(r.choice(["+1 999 999 9999", "+19999999999", "(999) 999-9999", "999.999.9999", "999-999-9999", "+44 9999 999999", "09999 999 999", "0049 (0)99 99999999", "+49 99 99999 999", "+49999999999", "099/99999-999", "09.99.99.99.99", "+33 9 99 99 99 99", "+34 999 99 99 99", "09 99 99 99 99", "+999999999999"]))
        return "phone", text + (f" ext. {r.randint(1, 99)}" if r.random() < 0.15 else "")

    def id_number(self) -> tuple[str, str]:
        return "id_number", self.d(self.r.choice(["999-99-9999", "999 99 9999", "99 999 999 999", "AA 99 99 99 A", "AA999999A", "99999999A", "AA9999999", "A9999999", "AA9999999", "99999999-A", "999999999999"]))

    def address(self) -> tuple[str, str]:
        r = self.r
        n, f = r.randint(1, 3000), self.family()
        words = " ".join([r.choice(["Old", "North", "High", "Upper"]), f][r.random() < 0.6 :])
        street = r.choice([
            f"{n} {words} {r.choice(STREETS[:14]).title()}{r.choice(['', '', '.'])}", f"{n}, rue {r.choice(['de la ', 'du ', 'des ', ''])}{f}", f"{n} bis rue {f}", f"{f}{r.choice(['straße', 'str.', 'weg', 'gasse', 'platz'])} {n % 200}", f"C/ {r.choice(['del ', '', 'de '])}{f} {n % 100}, {r.randint(1, 9)}º {r.choice('ABCD')}", f"P.O. Box {n}",
        ])
        return "address", street + r.choice(["", f", {self.family()}", f", {self.d('99999')} {self.family()}", f", {self.family()} {self.family()}"])

    def sentence(self) -> list:
        r = self.r
        m: Callable = lambda k: getattr(self, k)()
        noun, did = (lambda: r.choice(_PLAIN)), (lambda: r.choice(_DOING))
        given = lambda: ("name", r.choice(self.given).title())
        number = lambda form: self.d(form)
        kind = r.random()
        if kind < 0.34:
            return r.choice([
                lambda: [m("name"), f" {r.choice(['wrote', 'signed', 'checked', 'said'])} the {noun()}."], lambda: ["I met ", m("name"), f" about the {noun()}."], lambda: ["From: ", m("name"), "\n"], lambda: ["Please ask ", m("name"), " or ", m("name"), "."],
                lambda: [f"{r.choice(['Dr.', 'Prof.', 'Mr.', 'Mrs.', 'Ms', 'Frau', 'Herr', 'Mme'])} ", ("name", self.family()), r.choice([f" {did()} the {noun()}.", " asked for it.", ".", f" for the {noun()}."])],
                lambda: [f"Ask {r.choice(['Dr.', 'Prof.', 'Mr.', 'Mrs.'])} ", ("name", self.family()), f" for the {noun()}."], lambda: ["Thanks, ", given(), r.choice(["!", "."])], lambda: ["We said that ", given(), f" would see the {noun()}."], lambda: ["She told me to ask ", given(), f" or read the {noun()}."], lambda: ["Hi ", given(), f", the {noun()} is closed."],
                lambda: [r.choice(["They hoped that ", "It was decided that ", "We heard that ", "I think ", "She left because ", "so ", "while ", "Maybe ", "if "]), given(), f" {r.choice(['would', 'will', 'should', 'can', 'could', 'might', 'has', 'was', 'wants to', 'must'])} {r.choice(['sort', 'see', 'move', 'print', 'read', 'close'])} the {noun()}."],
                lambda: [f"I {did()} the {noun()} with ", given(), r.choice([".", f" and {noun()}.", ", then left."])], lambda: [f"The {noun()} is for ", given(), " and ", given(), "."],
                lambda: ['owner="', m("name"), '" '], lambda: ["| ", m("name"), " | ", m(r.choice(["id_number", "phone"])), " |"], lambda: ["- ", m("name"), ", ", m("phone"), ", ", m("email"), "\n"], lambda: ["contact: ", m("name"), " <", m("email"), ">"], lambda: [r.choice(["Regards,\n", "", "To:\n"]), m("name"), "\n", m("address"), r.choice(["\n", f"\n{r.choice(['Port', 'Castle', 'Key', 'Upper'])} {self.family()}, {self.d('99999')}\n"]), m("phone"), "\n", m("email"), "\n"], lambda: [f"The {noun()} of ", m("name"), " at ", m("address"), "."],
            ])()
        if kind < 0.6:
            return r.choice([
                lambda: ["Write to ", m("email"), " after lunch."], lambda: ["cc ", m("email"), "; bcc ", m("email"), "\n"], lambda: ["(", m("email"), ") "], lambda: ["mail=", m("email"), " tel=", m("phone"), " "], lambda: ["My number is ", m("phone"), "."], lambda: [m("phone"), " rang twice."], lambda: ["Call ", m("phone"), f" for the {noun()}."],
                lambda: ["The id is ", m("id_number"), "."], lambda: [f"Passport {''}", m("id_number"), " is mine."], lambda: ["ssn=", m("id_number"), ";tel=", m("phone"), " "], lambda: ["Record of ", m("name"), ", no. ", m("id_number"), "."], lambda: ["Signed: ", m("name"), " / ", m("id_number"), "\n"], lambda: ['"tax_ref": "', m("id_number"), '"'], lambda: ["bring ", m("id_number"), f" to the {noun()}."],
                lambda: ["I live at ", m("address"), " since May."], lambda: ["Send it to ", m("address"), "."], lambda: ["The new place is ", m("address"), "\n"], lambda: ["Anschrift: ", m("address"), "."],
            ])()
        word = r.choice(self.given).title()
        tool = self.family()
        return [r.choice([
            f"{word} the {noun()} as {did()} once {tool} is there. ", f"{word} all {noun()}s; {r.choice(self.given).title()} Mode is off. ", f"{word} {noun()}s are drawn at 300x200. ", f"{word} charts want 3-15-2024 labels. ", f"{tool} does the {noun()} better than {self.family()} when the {noun()} is slow. ", f"Run {number('999')} tests, then {number('9999')} more. ",
            f"Batch {number('2099-9999-9999')} has {number('99')} files. ", f"Ticket REQ-{number('2099-9999-9999')} is closed. ", f"Server {number('199.9.9.99')} answered on port {number('9999')}. ", f"Commit {number('9f9c9b9e9d9a99ab')} reverts build {number('9.99.9999')}. ", f"Window {number('0999')} to {number('0999')} is quiet. ", f"The ratio was {number('999')}:{number('999')} over {number('999')} runs. ",
            f"[{number('999999')}] {r.choice(['WARN', 'INFO', 'ERROR'])} the {noun()} was {did()}. ", "Use @dataclass here. ", f"pip install {noun()}@{number('9.9.9')} ", f"Chunk {number('999')} of {number('9999')} failed. ", f"Checksum {number('99')} is valid for block {number('999-99')}. ", f"At {number('2099-99-99')}T{number('99:99:99')} the {noun()} was {did()}. ", f"Key zz-pin-{number('9999')} turns daily. ",
            f"The {noun()} listed {number('9999')} {noun()}s and {did()} them. ", f"Bill the {number('9999')} tokens to the {noun()}. ", f"I {did()} the {noun()} with {tool} version {number('9.99.9')}. ", f"Order {number('999-9999999-9999999')} holds {number('9')} {noun()}s. ", f"isbn {number('999-9-999-99999-9')} is in the {noun()}. ", f"rows={number('9999999')} took {number('99.999')} s. ", f"five of one {noun()} and two of six. ", f"the {word.lower()} on the {noun()} was {did()} by {tool}. ", f"sha {number('9999999999')} of {noun()}. ", "payload " + "".join(r.choice(_CODE) for _ in range(r.randint(20, 200))) + " end ", f"epoch {number('1699999999')} and {number('1699999999999')} ms. ",
        ])]

    def text(self) -> tuple[str, set[tuple[str, int]]]:
        out, size, truth = [], 0, set()
        for _ in range(self.r.randint(1, 5)):
            for piece in [*self.sentence(), self.r.choice([" ", " ", "\n"])]:
                if isinstance(piece, tuple):
                    truth.add((piece[0], size))
                    piece = piece[1]
                out.append(piece)
                size += len(piece)
        return "".join(out), truth


class Detector:
    """Finder, trees and thresholds together."""

    def __init__(self, finder: Finder, models: dict[str, BoostedTrees]):
        self.finder, self.models = finder, models

    def mentions(self, texts: list[str | None], learnt: list[list[str] | None] | None = None) -> Iterator[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text's mentions, in order; null and empty texts have none. learnt: further given names
        for each text."""
        own = [frozenset(x or ()) for x in learnt] if learnt is not None else [frozenset()] * len(texts)
        spans = [self.finder.spans(t, o) if t else [] for t, o in zip(texts, own)]
        chance: dict[int, float] = {}
        for kind, model in self.models.items():
            own = [s for found in spans for s in found if s.kind == kind]
            if own:
                for s, p in zip(own, model.probability(np.array([s.features for s in own]))):
                    chance[id(s)] = float(p)
        for found in spans:
            good = [s for s in found if chance[id(s)] >= self.models[s.kind].threshold]
            # an email keeps the names in it to itself; else the likelier span counts, then the longer, then the first
            good.sort(key=lambda s: (s.kind != "email", -round(chance[id(s)], 2), s.start - s.end, s.start, KINDS.index(s.kind)))
            taken: list[Span] = []
            for s in good:
                if all(s.end <= t.start or s.start >= t.end for t in taken):
                    taken.append(s)
            yield [(s.kind, s.start, s.end) for s in sorted(taken, key=lambda s: s.start)]


def train(given: frozenset[str], path: str, texts: int = TRAINING_TEXTS, seed: int = SEED) -> dict[str, BoostedTrees]:
    """A model for each kind, from ``texts`` written texts; a quarter of them is held out to calibrate. Half of the given
    names are hidden from the finder's list of sure ones, so that names it doesn't know are learnt too."""
    listed = sorted(given)
    shy = frozenset(listed[::2])
    finder = Finder(given - shy, shy, path)
    writer = Writer(listed, seed)
    rows: dict[str, list] = {k: [] for k in KINDS}
    for n in range(texts):
        text, truth = writer.text()
        for s in finder.spans(text):
            rows[s.kind].append((n, s.features, (s.kind, s.start) in truth))
    models = {}
    for kind, own in rows.items():
        x, y = np.array([f for _, f, _ in own]), np.array([float(t) for *_, t in own])
        held = np.array([n % 4 == 3 for n, *_ in own])
        models[kind] = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return models


def lexicon_given(lexicon: DataFrame) -> frozenset[str]:
    """Given names, nicknames and the names these stand for; the lexicon is a fixed list, checked to be small."""
    rows = lexicon.limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} names")
    return frozenset(plain(x) for r in rows for x in (r.name, r.formal) if x)


#: A word counts as a given name if so many different rare words follow it, and such a share of all that follow it. So many
#: learnt words are sent to all tasks; if there are more, each text is joined with its own, to the same result.
LEARN_PARTNERS, LEARN_SHARE, LEARN_MOST = 3, 0.6, 100_000
#: Pieces of the tokenizer's vocabulary that a rare word needs.
RARE = 3


def learnt_given(texts: DataFrame, text: str, given: frozenset[str], path: str) -> DataFrame:
    """(word): words of the corpus that are used like given names: written with a capital before many different capitalised
    rare words, which themselves don't follow more small words than capitalised ones, as names of things do.

    Counted over all texts, each pair of words once, so that copies of a text and the size of the corpus don't count.
    """
    found = lambda first: F.regexp_extract_all(text, F.lit(rf"(?U)(?<![\w@.])({first} \p{{Lu}}\p{{Ll}}{{2,}})\b"))
    pairs = texts.where(F.col(text).isNotNull()).select(F.explode(F.concat(found(r"\p{Lu}\p{Ll}{2,}"), found(r"\p{Ll}+"))).alias("pair")).distinct()
    parts = checkpoint(pairs.select(F.split_part("pair", F.lit(" "), F.lit(1)).alias("first"), F.split_part("pair", F.lit(" "), F.lit(2)).alias("second")))
    small = F.col("first").rlike(r"^\p{Ll}")
    things = parts.groupBy("second").agg(F.count_if(small).alias("low"), F.count_if(~small).alias("high")).where("low > high").select("second", F.lit(True).alias("thing"))
    stop = frozenset(t.title() for t in (*TITLES, *given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(path)
        for batch in batches:
            both = [(a, b, t) for a, b, t in zip(*(c.to_pylist() for c in batch.columns)) if a not in stop]
            known = [b.lower() in given for _, b, _ in both]
            rare = [not k and not t and rarity(b) >= RARE for (_, b, t), k in zip(both, known)]
            yield pa.RecordBatch.from_pydict({"word": pa.array([plain(a) for a, *_ in both], pa.string()), "first": pa.array([a for a, *_ in both], pa.string()), "known": pa.array(known, pa.bool_()), "rare": pa.array(rare, pa.bool_())})

    used = parts.where(~small).join(things, "second", "left").select("first", "second", "thing").mapInArrow(run, "word STRING, first STRING, known BOOLEAN, rare BOOLEAN")
    words = used.groupBy("word", "first").agg(F.count_if("rare").alias("partners"), F.count("*").alias("n"), F.count_if("known").alias("known"))
    # what stands before given names is no given name itself
    return words.where((F.col("partners") >= LEARN_PARTNERS) & (F.col("partners") >= LEARN_SHARE * F.col("n")) & (F.col("known") <= 0.1 * F.col("n"))).select("word").distinct()


def detector(texts: DataFrame, text: str, lexicon: DataFrame, path: str | None = None) -> tuple[Detector, DataFrame | None]:
    """(detector, the learnt given names where they are too many to send to all tasks)."""
    path = path or tokenizer_path(TOKENIZER)
    given = lexicon_given(lexicon)
    learnt = learnt_given(texts, text, given, path)
    few = [r.word for r in learnt.limit(LEARN_MOST + 1).collect()]
    many = len(few) > LEARN_MOST
    return Detector(Finder(given, frozenset() if many else frozenset(few), path), train(given, path)), learnt if many else None


def with_learnt(df: DataFrame, text: str, learnt: DataFrame) -> DataFrame:
    """``df`` with the array __learnt of the learnt words that each text holds, by a join on its words."""
    rows = checkpoint(df.withColumn("__row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for w in {plain(w) for w in _WORDS.findall(t)}]
            yield pa.RecordBatch.from_pydict({"__row": pa.array([i for i, _ in out], pa.int64()), "word": pa.array([w for _, w in out], pa.string())})

    held = rows.select("__row", text).mapInArrow(run, "__row BIGINT, word STRING").join(learnt, "word").groupBy("__row").agg(F.collect_set("word").alias("__learnt"))
    return rows.join(held, "__row", "left").drop("__row")


def mentions(df: DataFrame, text: Column, keys: list[str], found: Detector, learnt: DataFrame | None = None) -> DataFrame:
    """keys, kind, start_pos, end_pos: every mention of each row's text; positions count code points from 0."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL("kind STRING, start_pos INT, end_pos INT").fields])
    arrow = to_arrow_schema(schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], []
            texts = batch.column(n)
            for a, b in slices(texts):
                more = batch.column(n + 1).slice(a, b - a).to_pylist() if batch.num_columns > n + 1 else None
                for i, own in enumerate(shared.value.mentions(texts.slice(a, b - a).to_pylist(), more)):
                    source += [a + i] * len(own)
                    rows += own
            at = pa.array(source, pa.int64())
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[], [], []], list(arrow)[n:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n)), *columns], schema=arrow)

    own = df.select(*keys, text.alias("__text")).where("__text is not null and __text != ''")
    return (own if learnt is None else with_learnt(own, "__text", learnt)).mapInArrow(run, schema)


def redact(text: str | None, own: list[tuple[str, int, int]]) -> str | None:
    """The text with each mention replaced by [KIND]; all else stays as it is."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in own:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str, found: Detector, learnt: DataFrame | None = None) -> DataFrame:
    """``df`` with its mentions in ``text`` replaced by placeholders; null stays null, all other columns and rows stay."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    schema, arrow = df.schema, to_arrow_schema(df.schema)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = []
            for a, b in slices(texts):
                part = texts.slice(a, b - a).to_pylist()
                more = batch.column(len(arrow)).slice(a, b - a).to_pylist() if batch.num_columns > len(arrow) else None
                new += [redact(t, own) for t, own in zip(part, shared.value.mentions(part, more))]
            columns = list(batch.columns)[: len(arrow)]
            columns[at] = pa.array(new, arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return (df if learnt is None else with_learnt(df, text, learnt)).mapInArrow(run, schema)


def all_texts(messages: DataFrame, codex: DataFrame) -> DataFrame:
    """(origin, rec_key, block, text) of message contents, Codex content blocks and string outputs of readable lines."""
    own = messages.select(F.lit("message").alias("origin"), F.col("id").alias("rec_key"), F.lit(0).alias("block"), F.col("content").alias("text"))
    line = readable(codex, "line")
    content, output = (F.try_variant_get("parsed", f"$.payload.{p}", "variant") for p in ("content", "output"))
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    text_of = lambda v: F.coalesce(string(F.try_variant_get(v, "$.text", "variant")), string(v))
    blocks = F.when(F.schema_of_variant(content) == "STRING", F.array(string(content))).otherwise(F.transform(F.try_variant_get(content, "$", "array<variant>"), text_of))
    entry = lambda origin, block, text: F.struct(F.lit(origin).alias("origin"), block.cast("int").alias("block"), text.alias("text"))
    entries = F.concat(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda t, i: entry("codex_text", i, t)), F.array(entry("codex_output", F.lit(0), string(output))))
    parsed = line.select(F.col("rec_id").cast("string").alias("rec_key"), F.inline(once(entries)))
    return own.unionByName(parsed).where("text is not null and text != ''")


def all_mentions(messages: DataFrame, codex: DataFrame, lexicon: DataFrame, path: str | None = None) -> DataFrame:
    """(origin, rec_key, block, kind, start_pos): the distinct mentions in all texts."""
    texts = all_texts(messages, codex)
    found = mentions(texts, F.col("text"), ["origin", "rec_key", "block"], *detector(texts, "text", lexicon, path))
    return found.select("origin", "rec_key", "block", "kind", "start_pos").distinct()
