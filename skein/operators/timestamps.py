"""Problem 6: every exported time as one UTC instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.instants import with_utc_micros
from skein.functions.jsons import readable


def with_instant(df: DataFrame, raw: str, zone: str | None = None, out: str = "utc_us") -> DataFrame:
    """``df`` with a BIGINT column of UTC microseconds of ``raw``; other columns are kept as they are.

    The default zone is the column ``zone`` (null: UTC). Unreadable, blank and null values give null, in any row.
    """
    return with_utc_micros(df, F.col(f"`{raw}`"), None if zone is None else F.col(f"`{zone}`"), out)


def header_zones(conversations: DataFrame) -> DataFrame:
    """(conversation_id, zone): the zone of each conversation; repeated headers collapse, the latest export that has one counts."""
    own = conversations.where(F.col("id").isNotNull() & F.col("tz").isNotNull())
    return own.groupBy(F.col("id").alias("conversation_id")).agg(F.max_by("tz", F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), "tz")).alias("zone"))


def conversation_instants(conversations: DataFrame) -> DataFrame:
    """(id, created_at, utc_us) of distinct header values."""
    zones = header_zones(conversations)
    raw = conversations.select("id", "created_at").distinct()
    return with_instant(raw.join(zones, raw.id == zones.conversation_id, "left"), "created_at", "zone").select("id", "created_at", "utc_us")


def message_instants(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, id, ts, utc_us) of distinct message values; messages without a header are read as UTC."""
    raw = messages.select("conversation_id", "id", "ts").distinct()
    return with_instant(raw.join(header_zones(conversations), "conversation_id", "left"), "ts", "zone").drop("zone")


def codex_times(codex: DataFrame) -> DataFrame:
    """(rec_id, session_file, line_no, field, raw, zone) of readable lines, zone the first payload.timezone of the session."""
    line = readable(codex, "line").select("rec_id", "session_file", "line_no", "parsed").select(
        "rec_id", "session_file", "line_no",
        *(F.try_variant_get("parsed", f"$.{p}", "string").alias(a) for p, a in (("timestamp", "t"), ("payload.timestamp", "pt"), ("payload.timezone", "tz"))),
    )
    line = line.distinct()
    zones = line.where("tz is not null").groupBy("session_file").agg(F.min_by("tz", F.struct("line_no", "tz")).alias("zone"))
    both = line.select("rec_id", "session_file", "line_no", F.inline(F.array(F.struct(F.lit("timestamp").alias("field"), F.col("t").alias("raw")), F.struct(F.lit("payload.timestamp").alias("field"), F.col("pt").alias("raw")))))
    return both.where("raw is not null").join(zones, "session_file", "left")


def all_instants(conversations: DataFrame, messages: DataFrame, codex: DataFrame) -> DataFrame:
    """(origin, rec_key, field, utc_us): distinct, only values that state an instant."""
    def row(df: DataFrame, origin: str, key: Column, field: Column) -> DataFrame:
        return df.select(F.lit(origin).alias("origin"), key.cast("string").alias("rec_key"), field.alias("field"), "utc_us")

    parts = [
        row(conversation_instants(conversations), "conversation", F.col("id"), F.lit("created_at")),
        row(message_instants(messages, conversations), "message", F.col("id"), F.lit("ts")),
        row(with_instant(codex_times(codex), "raw", "zone"), "codex", F.col("rec_id"), F.col("field")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("utc_us is not null").distinct()
