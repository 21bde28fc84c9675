"""Structured Streaming forms of the gap-based event operator (E8) and the
daily totals (E12).

Both are built-in stateful aggregations: ``session_window`` (a new session
when the gap exceeds ``gap_minutes``) and a tumbling ``window`` of one day,
with a watermark bounding the state kept for late rows. Output mode
``append`` emits a session / day once the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.session import stage_path


def _event_time(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumn(time_col, F.col(time_col).cast("timestamp"))


def stream_gap_events(stream: DataFrame, keys: Sequence[str], time_col: str, value: str,
                      gap_minutes: int, watermark: str = "2 hours") -> DataFrame:
    """Per key, sessions of rows closer than ``gap_minutes``: count, total,
    first and last time."""
    s = _event_time(stream, time_col).withWatermark(time_col, watermark)
    return (s.groupBy(*keys, F.session_window(time_col, f"{int(gap_minutes)} minutes").alias("session"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
                 F.min(time_col).alias("eventStart"), F.max(time_col).alias("eventEnd")))


def stream_daily_totals(stream: DataFrame, keys: Sequence[str], time_col: str, value: str,
                        scale: float = 1.0, watermark: str = "1 day") -> DataFrame:
    """Per key and calendar day (session time zone), the scaled total."""
    s = _event_time(stream, time_col).withWatermark(time_col, watermark)
    return (s.groupBy(*keys, F.window(time_col, "1 day").alias("day"))
            .agg((F.sum(value) * F.lit(scale)).alias("daily")))


def run_available(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over everything available now into a memory
    table (tests, smoke runs); the checkpoint lives in the shared folder."""
    q = (result.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", stage_path(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
