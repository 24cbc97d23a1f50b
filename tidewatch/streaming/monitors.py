"""Streaming twins of the monitors: watermarked windows and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows later than this behind the newest are dropped by the watermark.
LATENESS = "10 minutes"


def suppression_rate(decided: DataFrame, ts: str = "ts", window: str = "15 minutes") -> DataFrame:
    """Per service and tumbling window: decisions and suppressions."""
    return decided.withWatermark(ts, LATENESS).groupBy(F.window(ts, window), "service").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "suppress").alias("k"))


def first_deliveries(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Vendors deliver at least once: the first of each key within the watermark stays."""
    return events.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([key])
