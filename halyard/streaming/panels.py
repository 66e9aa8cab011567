"""An extension that the reference has no counterpart of: the daily panel of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_panel(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """asset, date, value, n: each day's last reading. readings (streaming or not): asset, ts, value, tie.

    On a stream a day is complete once the watermark, `late` behind the newest reading, has passed its end.
    """
    seen = readings.withWatermark("ts", late) if readings.isStreaming else readings
    day = seen.groupBy("asset", F.window("ts", "1 day")).agg(F.max_by("value", F.struct("ts", "tie")).alias("value"), F.count("*").alias("n"))
    return day.select("asset", F.to_date("window.start").alias("date"), "value", "n")
