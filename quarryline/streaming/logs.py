"""Capture, closure and progress logs, as batch tables or Structured Streaming replays of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import STEPS_PER_TURN, key_values

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """n, total and highest by tumbling window and key; rows later than the watermark are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")).select(F.col("w.start").alias("start"), by, "n", "total", "highest")


def append_log(stream: DataFrame, folder: str, checkpoint: str):
    """Append a stream to a Parquet log, each row once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closures(lines: DataFrame, line: str = "line") -> DataFrame:
    """steps and flag of a closure line of ``k=v`` tokens, and OK if the whole turn was made and flagged."""
    rows = lines.select("*", key_values(F.col(line)).alias("kv"))
    total = F.expr("try_cast(kv['total'] as int)")
    return rows.select(*lines.columns, total.alias("steps"), F.col("kv")["revolution"].alias("flag"), F.when((total == STEPS_PER_TURN) & (F.col("kv")["revolution"] == "1"), "OK").otherwise("ERROR").alias("state"))


def progress(lines: DataFrame, order: str, line: str, by: list[str]) -> DataFrame:
    """Each log line with the stage that the last ``[stage NN]`` line before it, or itself, opened."""
    opened = F.nullif(F.regexp_extract(line, r"\[stage (\w+)\]", 1), F.lit(""))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("stage", F.last(opened, ignorenulls=True).over(w))


def readiness(files: DataFrame, sides: tuple = ("left", "right"), poses: int = 25) -> DataFrame:
    """Sessions with ``poses`` non-empty files on each side and the same stems on both: session, ready."""
    per = files.where("size > 0").groupBy("session", "stem").agg(F.countDistinct("side").alias("sides"))
    return per.groupBy("session").agg(((F.count("*") == poses) & (F.min("sides") == len(sides))).alias("ready"))
