"""Bookmarks, typing and ingest: the same rules as batch queries and as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.ordered import neighbours


def toggle_state(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every event flips membership: set after an odd number.  Batch or stream."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flips"), F.max("ts").alias("last_ts")
    ).select(*keys, (F.col("flips") % 2 == 1).alias("bookmarked"), "flips", "last_ts")


def bookmarks(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is bookmarked now."""
    return toggle_state(events, keys).where("bookmarked").drop("flips", "bookmarked")


def recent_first(rows: DataFrame, ts: str, ident: str) -> DataFrame:
    return rows.orderBy(F.desc(ts), ident)


def debounce(events: DataFrame, keys: Sequence[str], gap_ms: int = 300, block_ms: int = 3_600_000) -> DataFrame:
    """Events not followed within the gap by another of the same key (batch).

    Time is cut into blocks, so a key with a third of all events stays spread out.
    """
    micros = _micros(events)
    cut = events.withColumn("_us", micros).withColumn("_block", F.floor(micros / (block_ms * 1000)))
    ahead = neighbours(
        cut, keys, "_block", [F.col("_us"), F.col("event_id")], F.col("_us"), None, "_next"
    )
    quiet = F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= gap_ms * 1000)
    return ahead.where(quiet).drop("_us", "_block", "_next")


def _micros(events: DataFrame) -> Column:
    """Microseconds of ``ts``; a time without zone is read off its own calendar fields."""
    if not isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        return F.unix_micros("ts")
    seconds = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    seconds = seconds + F.hour("ts") * 3600 + F.minute("ts") * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), "ts") * 1_000_000).cast("bigint")


def debounce_stream(events: DataFrame, keys: Sequence[str], gap_ms: int = 300, late: str = "10 seconds") -> DataFrame:
    """The same emissions as a stream: the last event of every session of the gap.

    Sessions also merge at exactly the gap, where the batch rule emits, hence one
    microsecond less.
    """
    session = F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds")
    rank = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).groupBy(*keys, session.alias("_s")).agg(
            F.max_by("event_id", rank).alias("event_id"), F.max("ts").alias("ts")
        ).select(*keys, "event_id", "ts")
    )


def read_event_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes a rerun start where this ended."""
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def ingest_pages(
    spark: SparkSession, folder: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
    out: str, checkpoint: str,
) -> StreamingQuery:
    """New page files only, through the given transform, appended to ``out``.

    The batch number is part of the output path and each batch overwrites its own folder,
    so a batch replayed after a failure does not double its rows.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_available(stream, write, checkpoint)
