"""Live latency statistics per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n, mean): non-zero values per window; rows later than ``late`` are not
    counted. Works for streams and tables alike."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = e.where((F.col(value) != 0) & ~F.isnan(value)).groupBy(F.window("_t", width).alias("w"), F.col(key))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), key, "n", "mean")
