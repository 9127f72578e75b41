"""Notes, graph and card files written from DataFrames, one task's rows at a time."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import file_name


def atomic_write(path: str | Path, text: str, root: str | Path) -> None:
    """Write a file below ``root`` so that readers see the old or the whole new content, also after a crash."""
    path, root = Path(path).resolve(), Path(root).resolve()
    if root != path and root not in path.parents:
        raise ValueError(f"{path} is outside {root}")
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    with part.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def front_matter_text(fields: dict[str, Column]) -> Column:
    """A front matter block of the fields that are not null; line breaks in values become spaces."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(c.cast("string"), r"\s*[\r\n]+\s*", " ")) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def conversation_notes(conversations: DataFrame, messages: DataFrame, folder: str = "AI-Conversations") -> DataFrame:
    """(file, text): a Markdown note a conversation, with its messages in order."""
    said = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), "content").alias("line")))).alias("ms"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Conversation "), F.substring("id", 1, 8)))
    own = conversations.join(said.withColumnRenamed("conversation_id", "id"), "id", "left")
    head = front_matter_text({"title": title, "type": F.lit("conversation"), "platform": F.col("platform"), "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), "model": F.col("model")})
    text = F.concat(head, F.lit("\n# "), title, F.lit("\n\n"), F.coalesce(F.array_join(F.transform("ms", lambda m: m["line"]), "\n\n"), F.lit("")), F.lit("\n"))
    return own.select(F.concat(F.lit(f"{folder}/"), file_name(title), F.lit(".md")).alias("file"), text.alias("text"), F.col("id").alias("key"))


def write_notes(notes: DataFrame, root: str) -> None:
    """Write (file, text[, key]) below ``root``, a folder that all executors share. Of equal files the one of the greatest key stays."""
    last = notes.groupBy("file").agg(F.max_by("text", "key").alias("text")) if "key" in notes.columns else notes

    def write(rows: Iterator) -> None:
        for r in rows:
            atomic_write(Path(root, r.file), r.text, root)

    last.foreachPartition(write)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two JSON-lines tables."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_cards(cards: DataFrame, path: str) -> None:
    """(front, back, tags) as tab-separated text: tabs and line breaks become spaces and <br>."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\t", " "), "\r?\n", "<br>")
    line = F.concat_ws("\t", clean("front"), clean("back"), F.array_join(F.transform("tags", lambda t: F.replace(F.replace(t, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("::"))), " "))
    cards.select(line).write.mode("overwrite").text(path)
