"""An extension: the station-hour collapse over a stream, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(observations: DataFrame, late: str = "2 hours", time: str = "obs_time") -> DataFrame:
    """(station_id, hour, temp_c, n_reports) per clock hour, emitted once it can't change any more."""
    stamped = observations.withColumn("_t", F.col(time).cast("timestamp"))
    hours = stamped.withWatermark("_t", late).groupBy(F.window("_t", "1 hour").alias("w"), "station_id")
    return hours.agg(F.avg("temp_c").alias("temp_c"), F.count("*").alias("n_reports")).select("station_id", F.col("w.start").alias("hour"), "temp_c", "n_reports")
