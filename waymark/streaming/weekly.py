"""Weekly evidence of a stream of interactions (an extension: the batch engine has the same by vle_weekly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import KEY


def weekly_stream(events: DataFrame, start: str, late: str = "7 days") -> DataFrame:
    """KEY, week_index and clicks per seven-day window from `start` (a UTC date); events later than `late` are dropped.

    events has KEY, ts (timestamp) and sum_click. Append mode emits a week once the watermark has passed its end.
    """
    origin = F.unix_timestamp(F.lit(f"{start} 00:00:00"))
    shift = F.window("ts", "7 days", startTime=f"{_offset(start)} seconds")
    weekly = events.withWatermark("ts", late).groupBy(*KEY, shift.alias("week")).agg(F.sum("sum_click").alias("clicks_total"), F.count(F.lit(1)).alias("n_events"))
    return weekly.select(*KEY, ((F.unix_timestamp("week.start") - origin) / 604800 + 1).cast("int").alias("week_index"), "clicks_total", "n_events")


def _offset(start: str) -> int:
    """Seconds of the start within the seven-day grid that windows count from."""
    import datetime

    return int(datetime.datetime.fromisoformat(start).replace(tzinfo=datetime.UTC).timestamp()) % 604800
