"""Log and progress streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])


def read_events(spark: SparkSession, path: str, files: int = 16, schema: T.StructType = EVENT) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tag_stage(lines: DataFrame, current: str) -> DataFrame:
    return lines.withColumn("stage", F.coalesce("stage", F.lit(current)))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows; what comes later than the watermark is dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark; state older than that is forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "state string, percent double, updates long"


def progress_states(events: DataFrame) -> DataFrame:
    """user_id, state, percent, updates after each batch: pending until the first event, running while percent (the largest
    value, kept within 0 to 100) is below 100, then complete; a `purchase` of value 0 fails it for good, while percent goes on.
    The outcome doesn't depend on the order of events within a batch."""

    def step(key, batches, held):
        import pandas as pd

        state, percent, updates = held.get if held.exists else ("PENDING", 0.0, 0)
        for pdf in batches:
            for kind, value in zip(pdf["event_type"], pdf["value"]):
                updates += 1
                percent = max(percent, min(100.0, max(0.0, float(value))))
                if kind == "purchase" and value == 0:
                    state = "FAILED"
                elif state != "FAILED":
                    state = "COMPLETE" if percent >= 100 else "RUNNING"
        held.update((state, percent, updates))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "percent": [percent], "updates": [updates]})

    return events.groupBy("user_id").applyInPandasWithState(step, f"user_id long, {STATE}", STATE, "update", "NoTimeout")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, batch by batch, into `sink`; the checkpoint makes a repeated run go on where it ended."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number: a batch that is tried again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
