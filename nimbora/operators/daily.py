"""Station-days in local solar time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.config import Climate


def local_day(hour: Column, lon: Column) -> Column:
    """Date of an hour moved by lon / 15 hours, halves to even."""
    return F.to_date(F.timestamp_add("HOUR", F.rint(lon / F.lit(15.0)).cast("int"), hour))


def daily_aggregate(hourly: DataFrame, c: Climate = Climate()) -> DataFrame:
    """19 measures per station-day. Days with fewer than ``min_obs_per_day`` temperatures are
    invalid; their temperature and precipitation become null, the rest stays.

    Days are made per source year, so a local day across new year exists twice, unless
    ``merge_year_boundary`` is set. Every key contains the station: over observations that are
    partitioned by it, hours, days and features need no exchange of their own.
    """
    keys = ([] if c.merge_year_boundary else ["source_year"]) + ["station_id"]
    known = hourly.withColumn("day", local_day(F.col("hour"), F.col("lon")))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0.0))
    days = known.groupBy(*keys, "day").agg(
        F.count("*").alias("n_hours"), F.count("temp_c").alias("n_temp_hours"), F.sum("n_reports").alias("n_reports"),
        F.avg("temp_c").alias("temp_mean_c"), F.max("temp_c").alias("temp_max_c"), F.min("temp_c").alias("temp_min_c"),
        F.avg("dewpoint_c").alias("dewpoint_mean_c"), F.avg("wind_speed_ms").alias("wind_mean_ms"), F.max("wind_speed_ms").alias("wind_max_ms"), F.avg("wind_u").alias("wind_u"), F.avg("wind_v").alias("wind_v"),
        F.avg("slp_hpa").alias("slp_mean_hpa"), F.avg("visibility_m").alias("visibility_mean_m"), F.avg("sky_cover_oktas").alias("sky_cover_mean_oktas"),
        total("precip_1h_mm").alias("precip_1h_mm"), F.count("precip_1h_mm").alias("n_precip_1h_reports"), F.max("precip_24h_mm").alias("precip_24h_mm"),
        F.max("snow_depth_cm").alias("snow_depth_cm"), F.min("ceiling_m").alias("ceiling_min_m"),
    )
    valid = F.col("n_temp_hours") >= c.min_obs_per_day
    only = lambda n: F.when(valid, F.col(n))
    return days.withColumns({"valid_day": valid, "precip_mm": only("precip_1h_mm"), **{n: only(n) for n in ("temp_mean_c", "temp_max_c", "temp_min_c")}})
