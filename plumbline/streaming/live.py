"""Logs that are still being written: events of single lines as they come, counted in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators.records import event


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (log_id, value) of the text files in a folder."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("log_id"), "value")


def events(stream: DataFrame) -> DataFrame:
    """Events of lines with a header, by their own line. What needs the lines around it is left to the batch parser."""
    text = F.trim("value")
    part = lambda i: F.regexp_extract(text, config.HEADER, i)
    held = stream.where(text.rlike(config.HEADER)).select(
        "log_id", F.try_to_timestamp(part(1), F.lit(config.TIME_FORMAT)).alias("ts"), part(2).alias("level"), part(3).alias("component"), part(4).alias("msg")
    )
    held = held.withColumn("_first", F.substring_index("msg", " ", 1)).withColumn("_event", event("msg", "_first"))
    kind = F.coalesce("_event.kind", F.when(F.col("level").isin(*config.ALERT_LEVELS), config.UNMATCHED))
    one = F.struct(kind.alias("event_type"), F.coalesce("_event.data", F.create_map().cast("map<string,string>")).alias("data"))
    return held.select(*(c for c in held.columns if c not in ("_first", "_event")), F.inline(F.when(kind.isNotNull(), F.array(one))))


def counts(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of each type, window and log; lines that come later than `late` after newer ones don't count."""
    held = events(stream).withWatermark("ts", late)
    return held.groupBy("log_id", F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("log_id", F.col("w.start").alias("start"), "event_type", "n")
