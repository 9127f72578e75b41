"""Problem 1: deeply nested records as related flat tables.

``shred`` reads each record as a stream of events, from start to end with an explicit stack, and emits path-value-ordinal
triples; ``related_tables`` groups the paths by their repeated ancestor, and ``pivot`` turns the triples of one of these
into a flat table whose rows carry the keys of their ancestors, so that parent and child tables join. Nothing is gathered
by record in Spark: a record may have any number of nodes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.session import checkpoint

#: Rows of one Arrow batch sent back to the JVM.
BATCH_ROWS = 20_000
#: How often a string that holds JSON, that holds a string with JSON, is opened.
MAX_UNWRAP = 2
#: Skips a value that isn't wanted.
SCAN = json.JSONDecoder().scan_once


class Shredder:
    """What is taken from a record.

    roots: paths of the envelopes in which the wanted object may stand; the first that fits is used. '' is the record
    itself, '[]' each element of a list, 'a[]' each element of the list at key a.
    maps: paths of objects whose keys are data, or of lists of objects that carry that key in a field: {path: key field}.
    keep: paths to emit; one that ends in '*' also takes all below it. Others are skipped unseen. None keeps all.
    bare: paths of which only the kind is wanted, not the value.
    embedded: paths of values that may be JSON in a string, once or twice.
    carry: {column: path of keys}: scalars of the object that all its triples repeat.
    """

    def __init__(
        self,
        roots: tuple[str, ...] = ("",),
        maps: dict[str, str] | None = None,
        keep: tuple[str, ...] | None = None,
        bare: tuple[str, ...] = (),
        embedded: tuple[str, ...] = (),
        carry: dict[str, str] | None = None,
    ):
        self.roots, self.maps, self.keep = roots, maps or {}, keep
        self.bare, self.embedded, self.carry = frozenset(bare), frozenset(embedded), carry or {}
        self.carried_paths = frozenset(self.carry.values())
        self._known: dict[str, tuple[bool, bool]] = {}

    def wanted(self, path: str) -> tuple[bool, bool]:
        """(emit it, look below it)."""
        if self.keep is None:
            return True, True
        if path not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            follows = lambda k, p: p == k or p.startswith(k) and (k == "" or p[len(k)] in ".[{")
            deep = any(k.endswith("*") and follows(k[:-1], path) for k in self.keep)
            self._known[path] = deep or path in self.keep, deep or any(follows(path, k.removesuffix("*")) and path != k for k in self.keep)
        return self._known[path]

    def triples(self, text: str) -> list[tuple]:
        """(carried..., root, path, ord, place, kind, value, seq) of each wanted event of a JSON text, in document order.

        ValueError if the text is no JSON. Of equal keys of one object the last counts. The text is read from start to end
        once, with an explicit stack, so that depth is unlimited; no record is built of it.
        """
        walk = Walk(self, text.removeprefix("\ufeff"))
        out = []
        for root, rows, carried in walk.objects():
            own = [carried.get(p) for p in self.carry.values()]
            out += [(*own, root, *row, seq) for seq, row in enumerate(r for r in rows if r is not None)]
        return out


class Walk:
    """One pass over a JSON text."""

    _SPACE = re.compile(r"[ \t\n\r]*")
    _NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
    # Bare words of a JSON text, the last three as Python's own parser takes them.
    _WORDS = [("null", "null", None), ("true", "boolean", "true"), ("false", "boolean", "false"), ("NaN", "number", "NaN"), ("Infinity", "number", "Infinity"), ("-Infinity", "number", "-Infinity")]

    def __init__(self, shredder: Shredder, text: str):
        self.s, self.text = shredder, text
        self.rows: list[tuple | None] = []
        self.carried: dict[str, str | None] = {}
        self.skip = True

    def objects(self) -> Iterator[tuple[int, list, dict]]:
        """(place among the roots, rows, carried values) of each object of the first root that fits."""
        keyed = {r.removesuffix("[]") for r in self.s.roots if r not in ("", "[]")}
        i = self.space(0)
        top = self.text[i : i + 1]
        parts: list[tuple[int, list, dict]] = []
        if top == "[" and "[]" in self.s.roots:
            end = self.elements(i, parts)
        elif top == "{" and keyed:
            end = self.keyed(i, keyed, parts)
        else:
            end = self.value(i, "" if "" in self.s.roots else None)
            parts = [(0, self.rows, self.carried)] if "" in self.s.roots else []
        if self.space(end) != len(self.text):
            raise ValueError("text after the value")
        return iter(parts)

    def take(self, parts: list, n: int) -> None:
        parts.append((n, self.rows, self.carried))
        self.rows, self.carried = [], {}

    def elements(self, i: int, parts: list) -> int:
        i, n = self.space(i + 1), 0
        if self.text[i : i + 1] == "]":
            return i + 1
        while True:
            i = self.space(self.value(i, ""))
            self.take(parts, n)
            n += 1
            if self.text[i : i + 1] == "]":
                return i + 1
            i = self.mark(i, ",")

    def keyed(self, i: int, keyed: set[str], parts: list) -> int:
        """The object at i: the envelope of one of the keys, or the wanted object itself."""
        path = "" if "" in self.s.roots else None
        mine: list[tuple[int, list, dict]] = []
        found: dict[str, list] = {}
        slot = self.open("object", path, "", [])
        seen: dict[str, tuple[int, int]] = {}
        i = self.space(i + 1)
        if self.text[i : i + 1] != "}":
            while True:
                key, i = self.key(i)
                if key in keyed and self.text[self.space(i) : self.space(i) + 1] in ("{", "["):
                    rows, carried, self.rows, self.carried = self.rows, self.carried, [], {}
                    found[key] = []
                    i = self.space(i)
                    if self.text[i] == "[":
                        i = self.elements(i, found[key])
                    else:
                        i = self.value(i, "")
                        self.take(found[key], 0)
                    self.rows, self.carried = rows, carried
                else:
                    i = self.member(i, key, path, "", [], seen)
                i = self.space(i)
                if self.text[i : i + 1] == "}":
                    break
                i = self.space(self.mark(i, ","))
        self.close(slot, path, len(seen))
        mine.append((0, self.rows, self.carried))
        for root in self.s.roots:
            key = root.removesuffix("[]")
            if root == "" or key in found:
                parts += mine if root == "" else found[key]
                break
        return i + 1

    # the parts of a text

    def space(self, i: int) -> int:
        return self._SPACE.match(self.text, i).end()

    def mark(self, i: int, mark: str) -> int:
        i = self.space(i)
        if self.text[i : i + 1] != mark:
            raise ValueError(f"no {mark} at {i}")
        return i + 1

    def key(self, i: int) -> tuple[str, int]:
        """The key at i, and the place after its colon."""
        key, i = scanstring(self.text, self.mark(i, '"'), True)
        return key, self.mark(i, ":")

    def scalar(self, i: int) -> tuple[str, str | None, int]:
        """(kind, value, end) of the scalar at i."""
        if self.text[i : i + 1] == '"':
            value, i = scanstring(self.text, i + 1, True)
            return "string", value, i
        m = self._NUMBER.match(self.text, i)
        if m:
            whole, fraction, power = m.groups()
            return "number", (repr(float(m.group())).replace("inf", "Infinity") if fraction or power else "0" if whole == "-0" else whole), m.end()
        for word, kind, value in self._WORDS:
            if self.text.startswith(word, i):
                return kind, value, i + len(word)
        raise ValueError(f"no value at {i}")

    # events

    def open(self, kind: str, path: str | None, place: str, ord_: list[str]) -> int | None:
        if path is None or not self.s.wanted(path)[0]:
            return None
        self.rows.append((path, ord_, place, kind, None))
        return len(self.rows) - 1

    def close(self, slot: int | None, path: str | None, members: int) -> None:
        if slot is not None and path not in self.s.bare:
            self.rows[slot] = (*self.rows[slot][:4], str(members))

    def member(self, i: int, key: str, path: str | None, place: str, ord_: list[str], seen: dict[str, tuple[int, int]]) -> int:
        """The whole value of a key of the outermost object."""
        below = None if path is None else f"{path}.{key}" if path else key
        if key in seen:
            self.drop(*seen[key])
        start = len(self.rows)
        end = self.value(i, below, f"{place}.{key}" if place else key, ord_)
        seen[key] = start, len(self.rows)
        return end

    def drop(self, start: int, end: int) -> None:
        self.rows[start:end] = [None] * (end - start)

    def inner(self, value: str) -> str | None:
        """The text of the object or list that a string holds, once or twice over."""
        for _ in range(MAX_UNWRAP):
            value = value.removeprefix("\ufeff").strip(" \t\n\r")
            if value[:1] in ("{", "["):
                return value
            if value[:1] != '"':
                return None
            try:
                value, end = scanstring(value, 1, True)
            except ValueError:
                return None
        return None

    def value(self, i: int, path: str | None, place: str = "", ord_: list[str] | None = None) -> int:
        """Walks the value at i and returns its end; path None: nothing of it is wanted."""
        s, text = self.s, self.text
        ord_ = ord_ or []
        # open containers: is it an object, path, place, ord, place of its row, members, rows of its keys, is it a map
        stack: list[list] = []
        while True:
            i = self.space(i)
            c = text[i : i + 1]
            emit, below = s.wanted(path) if path is not None else (False, False)
            if c in ("{", "[") and c:
                if not (emit or below) and self.skip and path not in s.carried_paths:
                    try:
                        i = SCAN(text, i)[1]
                    except StopIteration as error:
                        raise ValueError(f"no value at {error.value}") from None
                    except RecursionError:
                        # too deep to be skipped at once: from here on everything is walked
                        self.skip = False
                        continue
                else:
                    slot = self.open("object" if c == "{" else "array", path, place, ord_)
                    frame = [c == "{", path if below else None, place, ord_, slot, 0, {}, below and path in s.maps, path]
                    if path in s.carried_paths:
                        self.carried[path] = None
                    i = self.space(i + 1)
                    if text[i : i + 1] == ("}" if frame[0] else "]"):
                        i += 1
                        self.close(slot, path, 0)
                    else:
                        stack.append(frame)
                        i, path, place, ord_ = self.child(i, frame)
                        continue
            else:
                kind, value, i = self.scalar(i)
                if path in s.carried_paths:
                    self.carried[path] = value
                if emit or below:
                    self.leaf(path, place, ord_, kind, value, emit)
            # a value has ended
            while stack:
                frame = stack[-1]
                i = self.space(i)
                c = text[i : i + 1]
                if frame[0]:
                    frame[6][frame[9]] = (frame[10], len(self.rows))
                if c == ",":
                    i, path, place, ord_ = self.child(self.space(i + 1), frame)
                    break
                if c != ("}" if frame[0] else "]"):
                    raise ValueError(f"no end at {i}")
                i += 1
                stack.pop()
                self.close(frame[4], frame[8], len(frame[6]) if frame[0] else frame[5])
            else:
                return i

    def child(self, i: int, frame: list) -> tuple[int, str | None, str, list[str]]:
        """Where the next member of a container begins, and its path, place and ord."""
        is_object, path, place, ord_ = frame[:4]
        del frame[9:]
        if is_object:
            key, i = self.key(i)
            if key in frame[6]:
                self.drop(*frame[6].pop(key))
            frame += [key, len(self.rows)]
            if path is None:
                return i, None, "", ord_
            if frame[7]:
                return i, path + "{}", f"{place}.{key}", [*ord_, key]
            return i, f"{path}.{key}" if path else key, f"{place}.{key}" if place else key, ord_
        n = frame[5]
        frame[5] = n + 1
        if path is None:
            return i, None, "", ord_
        if frame[7]:
            key = self.field(i, self.s.maps[path], n)
            return i, path + "{}", f"{place}.{key}", [*ord_, key]
        return i, path + "[]", f"{place}[{n}]", [*ord_, str(n)]

    def field(self, i: int, field: str, n: int) -> str:
        """The key that an element of a list carries in a field, or its place."""
        if self.text[i : i + 1] != "{":
            return str(n)
        probe = Walk(Shredder(keep=(field,)), self.text)
        probe.value(i, "")
        found = [v for _, _, _, k, v in filter(None, probe.rows) if k in ("string", "number")]
        return found[-1] if found else str(n)

    def leaf(self, path: str, place: str, ord_: list[str], kind: str, value: str | None, emit: bool) -> None:
        inner = self.inner(value) if kind == "string" and path in self.s.embedded else None
        if inner is not None:
            part = Walk(self.s, inner)
            try:
                whole = part.space(part.value(0, path, place, ord_)) == len(inner)
            except ValueError:
                whole = False
            if whole:
                self.rows += part.rows
                return
        if emit:
            self.rows.append((path, ord_, place, kind, None if path in self.s.bare else value))


TRIPLE = "root INT, path STRING, ord ARRAY<STRING>, place STRING, kind STRING, value STRING, seq INT"


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    try:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    except UnicodeEncodeError:
        # halves of surrogate pairs are no characters
        clean = lambda x: x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(x, str) else [clean(y) for y in x] if isinstance(x, list) else x
        return pa.RecordBatch.from_arrays([pa.array([clean(x) for x in c], f.type) for c, f in zip(columns, schema)], schema=schema)


def shred(df: DataFrame, cell: str, keys: list[str], shredder: Shredder) -> DataFrame:
    """Triples of the JSON column ``cell``: the key columns, the carried ones, then root, path, ord, place, kind, value, seq.

    path has '[]' for the places of a list and '{}' for the keys of a map; ord holds those places and keys, outermost
    first; place is the path with them filled in. Cells that are null, empty or don't parse give no rows. Extra columns of ``df`` are not carried along.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.StringType()) for c in shredder.carry), *T.StructType.fromDDL(TRIPLE).fields])
    arrow = to_arrow_schema(schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)]
            for i, text in enumerate(batch.column(n)):
                text = text.as_py()
                if not text:
                    continue
                try:
                    found = shredder.triples(text)
                except ValueError:
                    continue
                own = [c[i] for c in columns]
                for t in found:
                    for c, v in zip(out, (*own, *t)):
                        c.append(v)
                    if len(out[-1]) >= BATCH_ROWS:
                        yield _batch(out, arrow)
                        out = [[] for _ in arrow]
        if out[-1]:
            yield _batch(out, arrow)

    return df.select(*keys, cell).where(F.col(cell).isNotNull()).mapInArrow(run, schema)


def pivot(triples: DataFrame, keys: list[str], ancestor: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one repeated ancestor: keys, root, ord (of the ancestor), kind, value, seq, and a column for each of ``fields``.

    fields: {column: path below the ancestor}. A record delivered twice gives its rows once; a field that is absent or
    null is null. Two values of one place, from records with equal keys, give the greater.
    """
    depth = ancestor.count("[]") + ancestor.count("{}")
    wanted = {f"{ancestor}.{p}" if ancestor else p: c for c, p in fields.items()}
    own = triples.where(F.col("path").isin(ancestor, *wanted))
    at = lambda p, c: F.when(F.col("path") == p, F.col(c))
    return own.groupBy(*keys, "root", F.slice("ord", 1, depth).alias("ord")).agg(
        F.max(at(ancestor, "kind")).alias("kind"),
        F.max(at(ancestor, "value")).alias("value"),
        F.min(at(ancestor, "seq")).alias("seq"),
        *(F.max(at(p, "value")).alias(c) for p, c in wanted.items()),
    ).where("kind is not null" if ancestor else "true")


def ancestor_of(path: str) -> str:
    """The path up to its last list place or map key; '' if it has none."""
    return path[: max(path.rfind("[]"), path.rfind("{}")) + 2] if "[]" in path or "{}" in path else ""


def related_tables(triples: DataFrame, keys: list[str], paths: list[str]) -> dict[str, DataFrame]:
    """{repeated ancestor: its flat table} for the wanted paths, columns named by the paths below the ancestor with '_' for '.'.

    A table's ord begins with the ord of its parent's rows. Paths that are ancestors themselves have their value in the
    column value.
    """
    groups: dict[str, dict[str, str]] = {}
    for p in paths:
        top = ancestor_of(p)
        own = groups.setdefault(top, {})
        if p != top:
            below = p.removeprefix(top).removeprefix(".")
            own[below.replace(".", "_")] = below
    return {top: pivot(triples, keys, top, fields) for top, fields in groups.items()}


PARTS = "mapping{}.message.content.parts"
CHATGPT = Shredder(
    roots=("conversations[]", "[]", ""),
    maps={"mapping": "id"},
    keep=("id", "mapping{}", "mapping{}.parent", "mapping{}.children[]", "mapping{}.message.author.role", "mapping{}.message.content.content_type", "mapping{}.message.content.parts", "mapping{}.message.content.parts[]"),
)
#: As above, for the links alone: no text of parts is carried along.
CHATGPT_LINKS = Shredder(
    CHATGPT.roots,
    CHATGPT.maps,
    keep=("id", "mapping{}", "mapping{}.parent", "mapping{}.children[]", "mapping{}.message.content.parts", "mapping{}.message.content.parts[]"),
    bare=("mapping{}.message.content.parts", "mapping{}.message.content.parts[]"),
)
CODEX = Shredder(
    keep=("payload.content", "payload.content[]", "payload.content[].type", "payload.content[].text", "payload.arguments*"),
    embedded=("payload.arguments",),
    carry={"call_id": "payload.call_id", "turn_id": "payload.turn_id"},
)
CODEX_LINKS = Shredder(
    keep=("payload.content", "payload.content[]", "payload.content[].type", "payload.arguments*"),
    bare=("payload.content", "payload.content[]"),
    embedded=("payload.arguments",),
    carry={"call_id": "payload.call_id"},
)


def chatgpt_tables(exports: DataFrame, shredder: Shredder = CHATGPT) -> dict[str, DataFrame]:
    """nodes and parts of ChatGPT exports; each row has rec_id, version (a hash of the payload), root (the conversation's place
    in its envelope) and the keys of its parents.

    nodes has parent_key: the node named in ``parent`` if the mapping holds it, else the first node that lists it in
    ``children``, else the conversation's id (empty if it has none). An export delivered twice gives its rows once.
    """
    own = ["rec_id", "version", "root"]
    source = exports.select("rec_id", F.xxhash64("payload").alias("version"), "payload")
    triples = checkpoint(shred(source, "payload", own[:2], shredder))
    # a part that is a string is the only one of its list
    bare = (F.col("path") == PARTS) & (F.col("kind") == "string")
    even = triples.withColumns({"ord": F.when(bare, F.concat("ord", F.array(F.lit("0")))).otherwise(F.col("ord")), "path": F.when(bare, f"{PARTS}[]").otherwise(F.col("path"))})
    tables = related_tables(even, own[:2], [p for p in shredder.keep if p != PARTS])
    nodes = tables["mapping{}"]
    if "message_author_role" not in nodes.columns:
        nodes = nodes.withColumn("message_author_role", F.lit(None).cast("string"))
    nodes = nodes.select(*own, F.col("ord")[0].alias("node_id"), "parent", F.col("message_author_role").alias("role"), "seq")
    listed = tables["mapping{}.children[]"].where("kind = 'string'").groupBy(*own, F.col("value").alias("node_id")).agg(F.min_by(F.col("ord")[0], "seq").alias("listed_by"))
    held = nodes.select(*own, F.col("node_id").alias("parent"), F.lit(True).alias("held"))
    linked = nodes.join(listed, [*own, "node_id"], "left").join(held, [*own, "parent"], "left").join(tables[""].select(*own, F.col("id").alias("conversation_id")), own, "left")
    parent = F.coalesce(F.when(F.col("held"), F.col("parent")), "listed_by", "conversation_id", F.lit(""))
    parts = tables[f"{PARTS}[]"].select(*own, F.col("ord")[0].alias("node_id"), F.col("ord")[1].alias("place"), "kind", "value")
    return {"nodes": linked.select(*own, "conversation_id", "node_id", parent.alias("parent_key"), "role", "seq"), "parts": parts}


def codex_tables(lines: DataFrame, shredder: Shredder = CODEX) -> dict[str, DataFrame]:
    """blocks and arguments of Codex lines, with rec_id, line_no and the keys of their parents."""
    keys = ["rec_id", "line_no"]
    triples = checkpoint(shred(lines.select(*keys, "line"), "line", keys, shredder))
    content = triples.withColumn("ord", F.when(F.col("path") == "payload.content", F.array(F.lit("0"))).otherwise(F.col("ord")))
    content = content.where("path != 'payload.content' or kind = 'string'")
    content = content.withColumn("path", F.when(F.col("path") == "payload.content", "payload.content[]").otherwise(F.col("path")))
    blocks = pivot(content, keys, "payload.content[]", {"type": "type", "text": "text"})
    blocks = blocks.select(*keys, F.col("ord")[0].alias("place"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("text", F.when(F.col("kind") == "string", F.col("value"))).alias("text"))
    leaf = triples.where("path like 'payload.arguments%' and (kind not in ('object', 'array') or value = '0') and not (path = 'payload.arguments' and kind = 'null')")
    name = F.regexp_replace("place", r"^payload\.arguments\.?", "")
    return {"blocks": blocks, "arguments": leaf.select(*keys, F.coalesce("call_id", F.lit("")).alias("call_id"), name.alias("name"), "kind", "value").distinct()}


def nested_links(exports: DataFrame, lines: DataFrame) -> DataFrame:
    """(origin, rec_id, kind, parent_key, child_key): the distinct parent-child links of readable rows of both tables."""
    chat, codex = chatgpt_tables(exports, CHATGPT_LINKS), codex_tables(lines, CODEX_LINKS)

    def link(df: DataFrame, origin: str, kind: str, parent: str, child: str) -> DataFrame:
        return df.select(F.lit(origin).alias("origin"), "rec_id", F.lit(kind).alias("kind"), F.expr(parent).alias("parent_key"), F.expr(child).alias("child_key"))

    nodes = link(chat["nodes"], "chatgpt", "node", "parent_key", "node_id")
    parts = link(chat["parts"], "chatgpt", "part", "node_id", "place")
    blocks = link(codex["blocks"], "codex", "block", "string(line_no)", "concat(place, ':', type)")
    leaves = link(codex["arguments"], "codex", "argument", "call_id", "name")
    return nodes.unionByName(parts).unionByName(blocks).unionByName(leaves).distinct()
