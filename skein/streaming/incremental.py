"""Streaming forms of the engine's incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from skein.operators.index import postings, to_index


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n) of a stream of events; rows later than ``late`` behind the newest are dropped, as is a repeated
    event_id within that time."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return own.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def index_notes(notes: DataFrame, folder: str, checkpoint: str, newest: str | None = None) -> DataStreamWriter:
    """Keep an index below ``folder`` as notes (path, text) arrive: new and edited ones are indexed, unchanged ones skipped.

    Of several versions of a path in one batch the one of the greatest ``newest`` (a column, such as the time of change)
    counts, then the greatest text; a null text is a deleted note, whose last batch has no postings.

    Each batch appends to notes (path, content_hash, batch) and postings (path, term, n, tf, batch); the last batch of a
    path counts. A batch that is run again replaces its own rows.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        order = F.struct(F.col(newest) if newest else F.lit(0), F.coalesce("text", F.lit("")))
        last = df.groupBy("path").agg(F.max_by(F.struct("text"), order).alias("v")).select("path", F.coalesce("v.text", F.lit("")).alias("text"))
        try:
            held = spark.read.parquet(f"{folder}/notes").where(F.col("batch") < n)
            held = held.groupBy("path").agg(F.max_by("content_hash", "batch").alias("content_hash"))
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            held = spark.createDataFrame([], "path STRING, content_hash STRING")
        fresh = to_index(last, held).persist()
        fresh.select("path", "content_hash").write.mode("overwrite").parquet(f"{folder}/notes/batch={n}")
        postings(fresh, "path").write.mode("overwrite").parquet(f"{folder}/postings/batch={n}")
        fresh.unpersist()

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def live_postings(spark, folder: str) -> DataFrame:
    """(path, term, n, tf) of the last batch of each path in the index that ``index_notes`` keeps; deleted notes have none."""
    last = spark.read.parquet(f"{folder}/notes").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/postings").join(last, ["path", "batch"], "left_semi").drop("batch")
