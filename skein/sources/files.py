"""Exports of chat platforms, agent sessions, calendars and note vaults, read from files as two related tables.

Every reader gives (conversations, messages):
conversations(path, id, title, platform, created_at, model) and
messages(path, conversation_id, position, id, role, content, ts, model), positions from 0 in the order of time, missing times
first, ties in the order of the file. Files and lines that don't parse, messages of unknown roles and blank messages give
nothing; so do conversations without an id or of fewer than ``least`` messages. Each file is one cell, so all of a
conversation's order is worked out within its row, without a shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.guards import once
from skein.functions.text import body, first_domain, front_matter
from skein.vocab import EVENT_TYPES

# Role names of the platforms.
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "model": "assistant", "system": "system", "developer": "system", "tool": "tool"}
SHIMS = ("<environment_context>", "<permissions instructions>")


def read_texts(spark: SparkSession, path: str | DataFrame, pattern: str) -> DataFrame:
    """(path, text) of the files below a folder whose names fit the pattern, or of one file; a DataFrame of that form is taken as it is."""
    if isinstance(path, DataFrame):
        return path.select("path", "text")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("path", once(F.try_parse_json(F.regexp_replace("text", "^﻿", ""))).alias("v")).where("v is not null")


def _get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _envelope(files: DataFrame, *keys: str) -> DataFrame:
    """(path, c): each conversation of a list, of the list at one of ``keys``, or the object itself."""
    lists = [_get("v", "$", "array<variant>"), *(_get("v", f"$.{k}", "array<variant>") for k in keys)]
    return _parsed(files).select("path", F.explode(F.coalesce(*lists, F.array("v"))).alias("c"))


def _role(role: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.lower(F.trim(role)))


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", _get(v, "$"))


def _joined(v: Column, by: str = "\n") -> Column:
    """A string as it is, or the texts of a list of strings and objects with a text."""
    texts = F.transform(_get(v, "$", "array<variant>"), lambda x: F.coalesce(_string(x), _get(x, "$.text")))
    return F.coalesce(_string(v), F.array_join(F.filter(texts, lambda t: t.isNotNull()), by))


def _time(v: Column) -> Column:
    """ISO text or epoch seconds as a timestamp; null if it is neither."""
    return F.coalesce(v.try_cast("timestamp"), F.timestamp_seconds(v.try_cast("double")))


def _tables(heads: DataFrame, platform: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Both tables from (path, id, title, created_at, ms[, head_model]), ms an array of (ts, n, id, role, content, model).

    A conversation's model is the one of its head, else the first that a message names.
    """
    sound = F.filter("ms", lambda m: m["role"].isNotNull() & (F.trim(m["content"]) != ""))
    ordered = heads.where("id is not null").withColumn("ms", once(F.array_sort(sound))).where(F.size("ms") >= least)
    model = F.get(F.filter(F.transform("ms", lambda m: m["model"]), lambda x: x.isNotNull()), F.lit(0))
    model = F.coalesce(F.nullif("head_model", F.lit("")), model) if "head_model" in heads.columns else model
    conversations = ordered.select("path", "id", "title", F.lit(platform).alias("platform"), "created_at", model.alias("model"))
    each = ordered.select("path", F.col("id").alias("conversation_id"), F.posexplode("ms").alias("position", "m"))
    return conversations, each.select("path", "conversation_id", "position", "m.id", "m.role", "m.content", "m.ts", "m.model")


def _message(ts: Column, n: Column, id_: Column, role: Column, content: Column, model: Column) -> Column:
    return F.struct(ts.alias("ts"), n.alias("n"), id_.alias("id"), role.alias("role"), content.alias("content"), model.alias("model"))


def claude(spark: SparkSession, path: str | DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """chat_messages with sender, text or content; a list, a 'conversations' list or one object a file."""
    c = _envelope(read_texts(spark, path, "*.json"), "conversations")

    def message(m: Column, n: Column) -> Column:
        text = F.coalesce(F.nullif(_get(m, "$.text"), F.lit("")), _joined(_get(m, "$.content", "variant")))
        return _message(_time(_get(m, "$.created_at")), n, _get(m, "$.uuid"), _role(_get(m, "$.sender")), text, _get(m, "$.model"))

    ms = F.transform(_get("c", "$.chat_messages", "array<variant>"), message)
    heads = c.select("path", F.coalesce(_get("c", "$.uuid"), _get("c", "$.id")).alias("id"), _get("c", "$.name").alias("title"), _time(_get("c", "$.created_at")).alias("created_at"), ms.alias("ms"))
    return _tables(heads.where("created_at is not null"), "claude", least)


def gemini(spark: SparkSession, path: str | DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """entries with role and parts; a conversation's model is the model slug of its header, else of its first message that has one."""
    c = _envelope(read_texts(spark, path, "*.json"), "conversations")

    def message(m: Column, n: Column) -> Column:
        return _message(_time(_get(m, "$.create_time")), n, _get(m, "$.id"), _role(_get(m, "$.role")), _joined(_get(m, "$.parts", "variant")), _get(m, "$.metadata.model_slug"))

    ms = F.transform(_get("c", "$.entries", "array<variant>"), message)
    heads = c.select("path", _get("c", "$.id").alias("id"), _get("c", "$.name").alias("title"), _time(_get("c", "$.create_time")).alias("created_at"), _get("c", "$.metadata.model_slug").alias("head_model"), ms.alias("ms"))
    return _tables(heads, "gemini", least)


def chatgpt(spark: SparkSession, path: str | DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """mapping trees: from the first root along first children to a leaf; a cycle ends after as many steps as there are nodes."""
    c = _envelope(read_texts(spark, path, "*.json"), "conversations")
    c = c.withColumn("m", once(_get("c", "$.mapping", "map<string, variant>"))).where("m is not null")
    root = F.get(F.filter(F.map_keys("m"), lambda k: ~F.coalesce(F.map_contains_key("m", _get(F.try_element_at("m", k), "$.parent")), F.lit(False))), F.lit(0))
    start = F.struct(root.alias("at"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, _: Column) -> Column:
        child = _get(F.try_element_at("m", s["at"]), "$.children[0]")
        return F.struct(F.when(s["at"].isNotNull(), child).alias("at"), F.when(s["at"].isNotNull(), F.concat(s["seen"], F.array(s["at"]))).otherwise(s["seen"]).alias("seen"))

    way = F.aggregate(F.sequence(F.lit(1), F.size("m")), start, step, lambda s: s["seen"])

    def message(k: Column, n: Column) -> Column:
        v = F.try_element_at("m", k)
        parts = F.transform(_get(v, "$.message.content.parts", "array<variant>"), _string)
        text = F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n")
        # the order is that of the tree, so the time is left out of the sorting
        return F.struct(n.alias("n"), _time(_get(v, "$.message.create_time")).alias("ts"), k.alias("id"), _role(_get(v, "$.message.author.role")).alias("role"), text.alias("content"), _get(v, "$.message.metadata.model_slug").alias("model"))

    heads = c.where(F.size("m") > 0).select("path", _get("c", "$.id").alias("id"), _get("c", "$.title").alias("title"), _time(_get("c", "$.create_time")).alias("created_at"), F.transform(way, message).alias("ms"))
    return _tables(heads.where("created_at is not null"), "chatgpt", least)


def _lines(files: DataFrame) -> DataFrame:
    """(path, n, v): the readable lines of each file."""
    each = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    return each.select("path", "n", once(F.try_parse_json("line")).alias("v")).where("v is not null")


def _last_file(conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sessions that several files hold, the one of the last path."""
    last = conversations.groupBy("id").agg(F.max("path").alias("path"))
    return conversations.join(last, ["id", "path"], "left_semi").select(*conversations.columns), messages.join(last.withColumnRenamed("id", "conversation_id"), ["conversation_id", "path"], "left_semi").select(*messages.columns)


def _grouped(rows: DataFrame, platform: str, least: int, **heads: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables from line rows with (path, ts, n, id, role, content, model); the lines of a file come together again in its row."""
    gathered = rows.groupBy("path").agg(*(c.alias(k) for k, c in heads.items()), F.collect_list(F.when(F.col("role").isNotNull(), F.struct("ts", "n", "id", "role", "content", "model"))).alias("ms"))
    return _last_file(*_tables(gathered, platform, least))


def cowork(spark: SparkSession, path: str | DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Agent sessions of JSON lines; side chains, audit files and files of sub-agents are left out, thinking is dropped."""
    files = read_texts(spark, path, "*.jsonl").where(~F.col("path").rlike(r"(?:^|/)audit[^/]*\.jsonl$|subagents"))
    v = _lines(files)

    def block(x: Column) -> Column:
        kind, result = _get(x, "$.type"), _get(x, "$.content", "variant")
        call = F.concat_ws(" ", F.lit("tool_use"), F.concat(_get(x, "$.name"), F.lit(":")), F.to_json(_get(x, "$.input", "variant")))
        return F.when(kind == "text", _get(x, "$.text")).when(kind == "tool_use", call).when(kind == "tool_result", _joined(result))

    content = _get("v", "$.message.content", "variant")
    blocks = F.filter(F.transform(_get(content, "$", "array<variant>"), block), lambda t: t.isNotNull() & (F.trim(t) != ""))
    said = _get("v", "$.type").isin("user", "assistant") & ~F.coalesce(_get("v", "$.isSidechain", "boolean"), F.lit(False))
    role = F.when(said, _role(F.coalesce(_get("v", "$.message.role"), _get("v", "$.type"))))
    rows = v.select("path", "n", _time(_get("v", "$.timestamp")).alias("ts"), _get("v", "$.uuid").alias("id"), role.alias("role"), F.coalesce(_string(content), F.array_join(blocks, "\n\n")).alias("content"), F.when(role == "assistant", _get("v", "$.message.model")).alias("model"), _get("v", "$.sessionId").alias("session"), _get("v", "$.cwd").alias("cwd"))
    last_part = F.nullif(F.regexp_extract(F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("n"))), "([^/]+)/*$", 1), F.lit(""))
    session = F.min_by("session", F.when(F.col("session").isNotNull(), F.col("n")))
    return _grouped(rows, "cowork", least, id=session, title=F.coalesce(last_part, session), created_at=F.min("ts"))


def codex(spark: SparkSession, path: str | DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sessions of rollout-*.jsonl; texts put in by the client are dropped, calls and outputs are of role tool, and the model
    is that of the last turn context. Sessions without a real user message are left out."""
    v = _lines(read_texts(spark, path, "rollout-*.jsonl"))
    kind, part = _get("v", "$.type"), _get("v", "$.payload.type")
    text = _joined(_get("v", "$.payload.content", "variant"))
    shim = F.coalesce(F.ltrim(text).rlike("^(?:" + "|".join(SHIMS) + ")"), F.lit(False))
    message, call, output = ((kind == "response_item") & (part == p) for p in ("message", "function_call", "function_call_output"))
    content = F.when(message & ~shim, text).when(call, F.concat_ws(": ", _get("v", "$.payload.name"), F.to_json(_get("v", "$.payload.arguments", "variant")))).when(output, F.coalesce(_string(_get("v", "$.payload.output", "variant")), F.to_json(_get("v", "$.payload.output", "variant"))))
    role = F.when(content.isNotNull(), F.when(message, _role(_get("v", "$.payload.role"))).otherwise("tool"))
    rows = v.select("path", "n", _time(_get("v", "$.timestamp")).alias("ts"), F.coalesce(_get("v", "$.payload.id"), _get("v", "$.payload.call_id")).alias("id"), role.alias("role"), content.alias("content"), F.when(kind == "turn_context", _get("v", "$.payload.model")).alias("own"), F.when(kind == "session_meta", _get("v", "$.payload.id")).alias("session"), F.when(kind == "session_meta", _get("v", "$.payload.cwd")).alias("cwd"))
    # a file is one cell, so its lines are few enough for one window
    rows = rows.withColumn("model", F.last("own", ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    conversations, messages = _grouped(rows, "codex", least, id=F.max("session"), title=F.nullif(F.regexp_extract(F.max("cwd"), "([^/]+)/*$", 1), F.lit("")), created_at=F.min("ts"))
    asked = messages.where("role = 'user'").select(F.col("conversation_id").alias("id")).distinct()
    return conversations.join(asked, "id", "left_semi").select(*conversations.columns), messages.join(asked.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_semi").select(*messages.columns)


def calendar(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, day, id, title, kind, starts, ends, location, attendees) of events; cancelled and undated ones are left out. The day
    is the one of the event's own offset."""
    e = _envelope(read_texts(spark, path, "*.json"), "items", "events").withColumnRenamed("c", "e")
    at = lambda k: F.coalesce(_get("e", f"$.{k}.dateTime"), _get("e", f"$.{k}.date"))
    who = F.array_sort(F.array_distinct(F.filter(F.transform(_get("e", "$.attendees", "array<variant>"), lambda a: F.coalesce(_get(a, "$.displayName"), _get(a, "$.email"))), lambda a: a.isNotNull())))
    title = F.coalesce(_get("e", "$.summary"), F.lit(""))
    kind = first_domain(F.concat_ws(" ", title, _get("e", "$.description")), EVENT_TYPES, "event")
    out = e.where(F.coalesce(_get("e", "$.status"), F.lit("")) != "cancelled").select("path", F.substring(at("start"), 1, 10).try_cast("date").alias("day"), _get("e", "$.id").alias("id"), title.alias("title"), kind.alias("kind"), at("start").try_cast("timestamp").alias("starts"), at("end").try_cast("timestamp").alias("ends"), _get("e", "$.location").alias("location"), F.coalesce(who, F.array().cast("array<string>")).alias("attendees"))
    return out.where("day is not null")


def vault(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, title, meta, body, content_hash) of Markdown notes; the title is the front matter's or the file's name."""
    files = read_texts(spark, path, "*.md")
    meta = front_matter(F.col("text"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select("path", F.coalesce(F.try_element_at(meta, F.lit("title")), stem).alias("title"), meta.alias("meta"), body(F.col("text")).alias("body"), F.sha2("text", 256).alias("content_hash"))


READERS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"claude": claude, "chatgpt": chatgpt, "gemini": gemini, "cowork": cowork, "codex": codex}


def ingest(spark: SparkSession, sources: dict[str, str | DataFrame], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Both tables of several platforms: {platform: path}. Unknown platforms are warned of and left out."""
    parts = []
    for platform, path in sources.items():
        if platform in READERS:
            parts.append(READERS[platform](spark, path, least))
        else:
            warnings.warn(f"no reader for {platform!r}: left out", stacklevel=2)
    if not parts:
        parts = [READERS["claude"](spark, spark.createDataFrame([], "path STRING, text STRING"), least)]
    conversations, messages = parts[0]
    for c, m in parts[1:]:
        conversations, messages = conversations.unionByName(c), messages.unionByName(m)
    return conversations, messages
