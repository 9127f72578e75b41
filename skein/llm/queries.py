"""Queries of the problems on texts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import canonical, components, leakage, mixing, names, privacy, replies, splitting
from skein.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized values, and whether they can be cut at white space."""
    pieces = splitting.oversized(table(spark, folder, "messages"), table(spark, folder, "conversations"), with_text=False)
    return pieces.where("pieces > 1").select("origin", "item_key", F.col("nospace").cast("int").alias("nospace")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal information in messages and Codex lines."""
    return privacy.all_mentions(*(table(spark, folder, t) for t in ("messages", "codex_lines", "name_lexicon")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of merged entities and of names that are the same."""
    return components.all_groups(table(spark, folder, "merge_map"), table(spark, folder, "extracted_relationships"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entities whose names mean the same person or organisation."""
    columns = ["id", "entity_type", "name", "aliases"]
    both = table(spark, folder, "entities").select(*columns).unionByName(table(spark, folder, "extracted_entities").select(*columns))
    return names.same_pairs(both, table(spark, folder, "name_lexicon"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Broken conversations and unanswered Codex turns."""
    return replies.dropped(*(table(spark, folder, t) for t in ("messages", "conversations", "codex_lines")))


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of exported conversations in the order of their reply trees."""
    return replies.export_order(table(spark, folder, "chatgpt_exports"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of held-out items."""
    return leakage.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of sources by target shares."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but differ as stored."""
    return canonical.look_alike_pairs(table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_order": p7_order, "p8_found": p8_found, "p9_mix": p9_mix, "p10_found": p10_found}
_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
_LONG = "SELECT DISTINCT '{origin}' AS origin, id AS item_key, CASE WHEN list_max(list_transform(regexp_split_to_array({text}, '{space}'), lambda x: length(x))) > 2000 THEN 1 ELSE 0 END AS nospace FROM {table} WHERE length({text}) > 2000"
_PAIRS = (
    "p(kind, a, b) AS (SELECT 'merge', merged_id, canonical_id FROM merge_map UNION ALL SELECT 'name', lower(regexp_replace(subject, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lower(regexp_replace(object, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) FROM extracted_relationships WHERE upper(trim(predicate)) = 'SAME_AS'), "
    "e AS (SELECT kind, a, b FROM p WHERE a <> '' AND b <> '' AND a <> b UNION SELECT kind, b, a FROM p WHERE a <> '' AND b <> '' AND a <> b)"
)
#: SQL where it can express a query over whole tables in time; the others are tested against brute force.
SQL: dict[str, str] = {
    "p2_found": _LONG.format(origin="message", text="content", table="messages", space=_SPACE) + " UNION ALL " + _LONG.format(origin="summary", text="summary", table="conversations", space=_SPACE),
    "p4_found": f"WITH RECURSIVE {_PAIRS}, r(kind, v, root) AS (SELECT kind, a, a FROM e UNION SELECT e.kind, e.b, r.root FROM r JOIN e ON e.kind = r.kind AND e.a = r.v) SELECT kind, min(root) AS group_key, v AS member_key FROM r GROUP BY kind, v HAVING min(root) <> v",
}
