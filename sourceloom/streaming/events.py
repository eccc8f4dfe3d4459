"""The run log as a stream: files of events in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexicon as L

EVENTS = "id long, research_id string, stage string, level string, message string, created_at timestamp"
LEVELS = ("info", "warning", "error")


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("level").isin(*LEVELS))


def append_log(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Copy a stream to a folder of Parquet; the sink's own log makes every event land once, whatever is repeated."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stage_rank(status: Column) -> Column:
    """Place of a status in the order of a run."""
    return F.array_position(F.array(*map(F.lit, L.STATUSES)), status)


def latest_status(events: DataFrame, key: str = "research_id") -> DataFrame:
    """(key, status, id) of the last event of each run; works on a table, and on a stream in complete or update mode."""
    return events.groupBy(key).agg(F.max(F.struct("id", "stage")).alias("x")).select(key, F.col("x.stage").alias("status"), F.col("x.id").alias("id"))


def rate_per_hour(events: DataFrame, time: str = "created_at", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events in each hour that slides by ten minutes; windows close when the watermark has passed."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, "1 hour", "10 minutes"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
