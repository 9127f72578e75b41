"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.nested import nested_links
from skein.operators.timestamps import all_instants
from skein.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Parent-child links of nested export records."""
    return nested_links(table(spark, folder, "chatgpt_exports"), table(spark, folder, "codex_lines"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC instant for every exported time."""
    return all_instants(*(table(spark, folder, t) for t in ("conversations", "messages", "codex_lines")))


QUERIES = {"p1_found": p1_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
