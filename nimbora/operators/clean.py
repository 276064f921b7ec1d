"""Quality filtering with counts of everything that is dropped, and the station-hour collapse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.config import CONTINUOUS, QC_OF, Climate


def select_stations(stations: DataFrame, c: Climate = Climate()) -> DataFrame:
    where = (F.col("country") == c.country) & F.col("lat").between(*c.lat_range) & F.col("lon").between(*c.lon_range)
    return stations.filter(where & (F.col("begin_year") <= c.start_year) & (F.col("end_year") >= c.end_year))


def kept_type(c: Climate) -> Column:
    """Exact match, padding and all; null is dropped."""
    return F.coalesce(F.col("report_type").isin(*c.report_types), F.lit(False))


def qc_failed(name: str, c: Climate) -> Column:
    return F.coalesce(F.col(QC_OF[name]).isin(*c.qc_fail), F.lit(False)) & F.col(name).isNotNull()


def out_of_range(name: str, c: Climate) -> Column:
    low, high = c.bounds[name]
    return F.col(name).isNotNull() & ~F.col(name).between(low, high)


def clean(observations: DataFrame, c: Climate = Climate()) -> DataFrame:
    """Hourly report types only; values with a failing flag, then values out of bounds, become null."""
    kept = observations.filter(kept_type(c))
    flagged = kept.withColumns({n: F.when(~qc_failed(n, c), F.col(n)) for n in QC_OF if n in kept.columns})
    return flagged.withColumns({n: F.when(~out_of_range(n, c), F.col(n)) for n in c.bounds if n in kept.columns})


def report_type_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("report_type").agg(F.count("*").alias("n"))


def accounting(observations: DataFrame, c: Climate = Climate(), by: list[str] | None = None) -> DataFrame:
    """All counters in one pass: rows, dropped rows, and per variable: values, flag failures,
    range failures (of values that passed their flag), values left; a row, or one for each ``by``."""
    names = [n for n in QC_OF if n in observations.columns]
    kept = kept_type(c)
    parts = [F.count("*").alias("n_raw"), F.count_if(~kept).alias("n_dropped")]
    for n in names:
        flag = qc_failed(n, c)
        wide = out_of_range(n, c) & ~flag if n in c.bounds else F.lit(False)
        parts += [F.count_if(kept & F.col(n).isNotNull()).alias(f"raw_{n}"), F.count_if(kept & flag).alias(f"qc_{n}"), F.count_if(kept & wide).alias(f"range_{n}")]
        parts.append(F.count_if(kept & F.col(n).isNotNull() & ~flag & ~wide).alias(f"clean_{n}"))
    return observations.groupBy(*by or []).agg(*parts)


def by_variable(account: DataFrame, what: str) -> DataFrame:
    """(variable, n) of one kind of counter."""
    names = [n for n in QC_OF if f"{what}_{n}" in account.columns]
    return account.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{what}_{n}").alias("n")) for n in names])).alias("x")).select("x.*")


def hour_collapse(cleaned: DataFrame) -> DataFrame:
    """Station-hours: means, the wind's mean unit vector, precipitation by period, counts of reports.

    The source's year is a key, as hours are collapsed file by file.
    """
    moving = F.col("wind_speed_ms").isNotNull()
    turn = F.radians("wind_dir")
    period = lambda h: F.max(F.when(F.col("precip_period_h") == h, F.col("precip_mm")))
    return cleaned.groupBy("source_year", "station_id", "lat", "lon", F.date_trunc("hour", "obs_time").alias("hour")).agg(
        *[F.avg(n).alias(n) for n in CONTINUOUS],
        F.avg(F.when(moving, F.sin(turn))).alias("wind_u"), F.avg(F.when(moving, F.cos(turn))).alias("wind_v"),
        period(1.0).alias("precip_1h_mm"), period(24.0).alias("precip_24h_mm"), F.max("snow_depth_cm").alias("snow_depth_cm"), F.count("*").alias("n_reports"),
    )


def identity_holds(account: DataFrame, hourly: DataFrame) -> DataFrame:
    """Rows in, dropped, collapsed and left: raw - dropped - collapsed = clean."""
    left = hourly.agg(F.count("*").alias("n_clean"), F.coalesce(F.sum("n_reports"), F.lit(0)).alias("reports"))
    both = account.select("n_raw", "n_dropped").crossJoin(F.broadcast(left))  # one row each
    return both.select("n_raw", "n_dropped", (F.col("reports") - F.col("n_clean")).alias("n_collapsed"), "n_clean", (F.col("n_raw") - F.col("n_dropped") == F.col("reports")).alias("holds"))


def finite(names: list[str]) -> Column:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return reduce(lambda a, b: a & b, map(ok, names))


def grand_totals(account: DataFrame) -> DataFrame:
    """(kind, total): each kind of counter summed over all variables."""
    kinds = ("raw", "qc", "range", "clean")
    total = lambda k: reduce(lambda a, b: a + b, [F.col(c) for c in account.columns if c.startswith(f"{k}_") and c != "raw_n"], F.lit(0))
    return account.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), total(k).cast("long").alias("total")) for k in kinds])).alias("x")).select("x.*")


def percent_left(account: DataFrame) -> DataFrame:
    """(variable, pct): values left after cleaning in percent of the rows of kept types, one decimal."""
    kept = account.select((F.col("n_raw") - F.col("n_dropped")).alias("kept"))
    met = by_variable(account, "clean").crossJoin(F.broadcast(kept))  # one row
    return met.select("variable", F.round(F.try_divide(100 * F.col("n"), F.col("kept")), 1).alias("pct"))
