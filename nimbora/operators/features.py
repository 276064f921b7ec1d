"""Annualised climate features of stations, their coverage, scaling and percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, PRECIP_FEATURES, Climate
from nimbora.functions.units import c_to_f, m_to_mi, mm_to_in, ms_to_mph
from nimbora.operators.clean import finite
from nimbora.operators.ranks import grouped_ranks, holds


def station_features(days: DataFrame, c: Climate = Climate()) -> DataFrame:
    """One hash aggregation per station, one projection after it. Ratios with nothing below
    are null. Precipitation features of a station without a reporting gauge are null."""
    v, month = F.col("valid_day"), F.month("day")
    winter, summer = month.isin(12, 1, 2), month.isin(6, 7, 8)

    def mean(x, *where: Column) -> Column:
        cond = reduce(lambda a, b: a & b, where, F.lit(True))
        return F.avg(F.when(cond, F.col(x) if isinstance(x, str) else x))

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    has = lambda n: F.col(n).isNotNull()
    raw = days.groupBy("station_id").agg(
        F.count("*").alias("n_days_with_data"), count(v).alias("n_valid_days"), F.sum("n_reports").alias("n_hourly_reports"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct(F.year("day")).alias("n_years"),
        F.count("temp_mean_c").alias("n_temp_days"),
        *[count(v & has(x)).alias(n) for n, x in (("n_dewpoint_days", "dewpoint_mean_c"), ("n_wind_days", "wind_mean_ms"), ("n_visibility_days", "visibility_mean_m"), ("n_slp_days", "slp_mean_hpa"), ("n_sky_days", "sky_cover_mean_oktas"), ("n_snow_depth_days", "snow_depth_cm"), ("n_precip_24h_days", "precip_24h_mm"))],
        count(v & (F.col("n_precip_1h_reports") > 0)).alias("n_days_with_precip_report"),
        mean("temp_mean_c").alias("t"), mean("temp_mean_c", winter).alias("t_winter"), mean("temp_mean_c", summer).alias("t_summer"), mean(F.col("temp_max_c") - F.col("temp_min_c")).alias("swing"),
        count(F.col("temp_max_c") >= c.hot_c).alias("hot"), count(F.col("temp_min_c") <= c.freeze_c).alias("freeze"),
        F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("rain"), F.coalesce(F.sum(F.when(summer, F.col("precip_mm"))), F.lit(0.0)).alias("rain_summer"),
        count(F.col("precip_mm") >= c.wet_mm).alias("wet"), count((F.col("precip_mm") >= c.wet_mm) & (F.col("temp_mean_c") <= c.freeze_c)).alias("frozen"),
        mean("dewpoint_mean_c", v, summer).alias("dew_summer"), mean(F.col("temp_mean_c") - F.col("dewpoint_mean_c"), v).alias("dryness"), mean("wind_mean_ms", v).alias("wind"),
        mean("visibility_mean_m", v).alias("vis"), mean("slp_mean_hpa", v).alias("mean_slp_hpa"), mean("sky_cover_mean_oktas", v).alias("mean_sky_cover_oktas"), mean("snow_depth_cm", v).alias("mean_snow_depth_cm"),
    )
    per_year = lambda n: F.col(n) * F.try_divide(F.lit(c.year_days), F.col("n_valid_days"))
    gauge = F.col("n_days_with_precip_report") >= F.lit(c.min_precip_report_fraction) * F.col("n_valid_days")
    made = {
        "annual_mean_temp_f": c_to_f(F.col("t")), "winter_mean_temp_f": c_to_f(F.col("t_winter")), "summer_mean_temp_f": c_to_f(F.col("t_summer")),
        "seasonal_temp_range_f": c_to_f(F.col("t_summer")) - c_to_f(F.col("t_winter")), "diurnal_temp_range_f": F.col("swing") * 9 / 5, "hot_days_per_year": per_year("hot"), "freeze_days_per_year": per_year("freeze"),
        "annual_precip_in": mm_to_in(per_year("rain")), "wet_days_per_year": per_year("wet"), "summer_precip_fraction": F.try_divide("rain_summer", "rain"), "frozen_precip_days_per_year": per_year("frozen"),
        "summer_dewpoint_f": c_to_f(F.col("dew_summer")), "annual_dewpoint_depression_f": F.col("dryness") * 9 / 5, "mean_wind_mph": ms_to_mph(F.col("wind")),
    }
    made |= {n: F.when(gauge, made[n]) for n in PRECIP_FEATURES}
    made |= {"mean_visibility_mi": m_to_mi(F.col("vis")), "has_precip_gauge": gauge, "valid_day_fraction": F.col("n_valid_days") / F.lit(c.window_days)}
    gone = ["t", "t_winter", "t_summer", "swing", "hot", "freeze", "rain", "rain_summer", "wet", "frozen", "dew_summer", "dryness", "wind", "vis"]
    return raw.withColumns(made).drop(*gone)


def with_stations(features: DataFrame, stations: DataFrame, small: int = 100_000) -> DataFrame:
    """Left join on station_id; the station list is broadcast if it is small."""
    side = F.broadcast(stations) if stations.limit(small + 1).count() <= small else stations
    return features.join(side, "station_id", "left")


def keep_filter(features: DataFrame, c: Climate = Climate()) -> DataFrame:
    """Stations with enough valid days and all model features finite."""
    return features.filter((F.col("valid_day_fraction") >= c.min_days_fraction) & finite(FEATURE_NAMES))


def missing_counts(features: DataFrame, c: Climate = Climate()) -> DataFrame:
    """(feature, n_missing) among stations with enough days."""
    enough = features.filter(F.col("valid_day_fraction") >= c.min_days_fraction)
    one = enough.agg(*[F.count_if(~finite([n])).alias(n) for n in FEATURE_NAMES])
    return one.unpivot([], FEATURE_NAMES, "feature", "n_missing")


def coverage(features: DataFrame) -> DataFrame:
    """(variable, pct): days with the variable in percent of valid days, over all stations."""
    of = ["temp", "dewpoint", "wind", "visibility", "slp", "sky", "snow_depth", "precip_24h"]
    names = {v: f"n_{v}_days" for v in of} | {"precip_report": "n_days_with_precip_report"}
    one = features.agg(*[F.round(F.try_divide(100 * F.sum(n), F.sum("n_valid_days")), 2).alias(v) for v, n in names.items()])
    return one.unpivot([], list(names), "variable", "pct")


def zscores(features: DataFrame, names: list[str] = FEATURE_NAMES) -> DataFrame:
    """station_id and z (array, in the order of ``names``): population standard deviations, of which 0 counts as 1."""
    moments = features.agg(*[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s_{i}") for i, n in enumerate(names)])
    met = features.crossJoin(F.broadcast(moments))  # the right side is one row
    z = lambda i, n: (F.col(n) - F.col(f"m_{i}")) / F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}"))
    return met.select("station_id", F.array(*[z(i, n) for i, n in enumerate(names)]).alias("z"))


def percentile_ranks(features: DataFrame, names: list[str] = FEATURE_NAMES) -> DataFrame:
    """station_id and pct_*: average rank in percent, by ranks over range partitions of
    (feature, value), so any number of tasks share the work; nulls have no rank."""
    long = features.unpivot("station_id", names, "feature", "value").filter("value is not null")
    ranked = grouped_ranks(long, "feature", "value")
    pct = ranked.select("feature", "value", ((F.col("before") + (F.col("n") + 1) / F.lit(2.0)) * 100 / F.col("total")).alias("pct"))
    met = long.join(pct, ["feature", "value"])
    return met.groupBy("station_id").agg(*[F.max(F.when(F.col("feature") == n, F.col("pct"))).alias(f"pct_{n}") for n in names])


def describe(features: DataFrame, names: list[str] = FEATURE_NAMES) -> DataFrame:
    """(feature, count, nulls, mean, std, min, p25, p50, p75, max): the sample deviation, quartiles at
    the nearest index of the sorted values; found by ranks, so no column is gathered in one task."""
    long = features.unpivot([], names, "feature", "value")
    moments = long.groupBy("feature").agg(F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    ranked = grouped_ranks(long.filter("value is not null"), "feature", "value")
    spot = lambda p: F.rint(F.lit(p) * (F.col("total") - 1))
    parts = ranked.groupBy("feature").agg(*[F.max(F.when(holds(spot(p)), F.col("value"))).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])
    return moments.join(parts, "feature", "left").select("feature", "count", "nulls", "mean", "std", "min", "p25", "p50", "p75", "max")


def vectors32(points: DataFrame, vector: str = "z") -> DataFrame:
    """The vectors in single precision, as they are stored for serving."""
    return points.withColumn(vector, F.col(vector).cast("array<float>"))
