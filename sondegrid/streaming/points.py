"""Streams of points: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sondegrid.grid import GridSpec
from sondegrid.sources.xyz import XyzConfig, parse_xyz


def grid_counts(lines: DataFrame, spec: GridSpec, config: XyzConfig = XyzConfig(), line: str = "value") -> DataFrame:
    """(row, col, n, mean) of a stream of lines; the state is one row for each cell of the grid."""
    p = spec.index(parse_xyz(lines, config, line))
    return p.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("z").alias("mean"))


def hourly(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """Counts by hour and kind; events later than the watermark are dropped, which bounds the state."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), kind, "n")
