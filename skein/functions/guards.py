"""Column helpers that steer the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """``value``, evaluated once a row: filters on it are not pushed below its projection, which would copy its expression.

    The partition number is never negative, so the value never changes; it only counts as non-deterministic.
    """
    return F.when(F.spark_partition_id() >= 0, value)
