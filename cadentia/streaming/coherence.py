"""Coherence over a stream: participants in sliding bins of 100 ms, every 50 ms, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_participants(taps: DataFrame, time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """(stem_id, bin start, participants) of bins that the watermark has closed; the count is exact, so a bin's state holds its participants until the watermark closes it."""
    w = F.window(time, "100 milliseconds", "50 milliseconds")
    return taps.withWatermark(time, late).groupBy("stem_id", w.alias("bin")).agg(F.size(F.collect_set("participant")).cast("long").alias("n_participants")).select("stem_id", F.col("bin.start").alias("bin_start"), "n_participants")
