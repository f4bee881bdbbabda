"""Statistics of cells that arrive as a stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_row_params(cells: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, row_id, n, mean, stdev of a stream (or table) of row_id, value and an event time.

    State is one aggregate for each row and open window; windows close at the watermark, so it doesn't grow with the stream.
    """
    grouped = cells.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "row_id")
    out = grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    return out.select(F.col("w.start").alias("window_start"), "row_id", "n", "mean", "stdev")
