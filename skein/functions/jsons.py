"""JSON cells as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.guards import once


def readable(df: DataFrame, cell: str, out: str = "parsed") -> DataFrame:
    """Rows whose cell parses as JSON (a leading byte order mark aside), with the VARIANT column ``out``."""
    return df.withColumn(out, once(F.try_parse_json(F.regexp_replace(F.col(cell), "^\ufeff", "")))).where(F.col(out).isNotNull())
