"""The engine's inputs made from the general test tables: the same arithmetic as the SQL in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, Climate
from nimbora.operators.features import keep_filter, percentile_ranks, station_features, with_stations, zscores
from nimbora.operators.text_index import postings
from nimbora.plans.api import neighbor_edges, search_text
from nimbora.sources.records import write_clustered
from nimbora.sources.scratch import Scratch

#: What is sparse in the test tables gets smaller limits; everything else keeps its default.
SPARSE = Climate(window_years=7.0, min_days_fraction=0.14)
EVENTS = replace(SPARSE, min_obs_per_day=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(a.cast("string"), 6, "0"), F.lit("-"), F.lpad(b.cast("string"), 5, "0"))


def _lat(k: Column) -> Column:
    return 24 + (k * 7919 % 26000) / F.lit(1000.0)


def _lon(k: Column) -> Column:
    return -125 + (k * 104729 % 59000) / F.lit(1000.0)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    met = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return met.select(
        _id(k, F.col("s_nationkey")).alias("station_id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 5 == 0, "CA").otherwise("US").alias("country"), F.col("n_name").alias("state"),
        F.concat(F.lit("K"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("icao"), _lat(k).alias("lat"), _lon(k).alias("lon"), (F.col("s_acctbal") / 10).alias("elev_m"),
        (2010 + k % 8).cast("int").alias("begin_year"), (2020 + k % 7).cast("int").alias("end_year"), k.alias("k"),
    )


def observations(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    """Reports from events: one pass, no shuffle. With ``years``, every n-th event lies n years back."""
    e = table(spark, sf_dir, "events")
    if years > 1:
        e = e.withColumn("ts", F.expr(f"ts - make_interval(cast(event_id % {years} as int))"))
    k, i, u = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "signup", "SOD  ").when(F.col("event_type") == "view", "FM-15").when(F.col("event_type") == "click", "FM-16").when(F.col("event_type") == "purchase", "CRN05").otherwise("FM-12")
    digit = lambda x: (F.floor(x) % 10).cast("string")
    period = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 24.0)
    return e.select(
        _id(u, u % 25).alias("station_id"), _lat(u).alias("lat"), _lon(u).alias("lon"), F.col("ts").alias("obs_time"), F.year("ts").alias("source_year"), kind.alias("report_type"),
        F.when(k != 99, F.col("value") - 20).alias("temp_c"), digit(k).alias("temp_qc"), F.when(k % 7 != 0, F.col("value") - 30).alias("dewpoint_c"), digit(k / 10).alias("dewpoint_qc"),
        (i * 37 % 360).cast("double").alias("wind_dir"), digit(i).alias("wind_dir_qc"), F.when(i % 11 != 0, i % 800 / F.lit(10.0)).alias("wind_speed_ms"), digit(i / 10).alias("wind_speed_qc"),
        (890 + i % 2100 / F.lit(10.0)).alias("slp_hpa"), digit(i / 100).alias("slp_qc"), (i * 7 % 170000).cast("double").alias("visibility_m"), digit(i / 3).alias("visibility_qc"),
        (i * 3 % 23000).cast("double").alias("ceiling_m"), digit(i / 7).alias("ceiling_qc"), period.alias("precip_period_h"), F.when(period.isNotNull(), k % 40 / F.lit(10.0)).alias("precip_mm"), digit(i / 5).alias("precip_qc"),
        F.when(k % 3 == 0, k * 6.0).alias("snow_depth_cm"), digit(i / 13).alias("snow_depth_qc"), (k % 10).cast("double").alias("sky_cover_oktas"), digit(i / 17).alias("sky_cover_qc"), i.alias("event_id"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width records from events, to be parsed back."""
    e = table(spark, sf_dir, "events")
    k, i, u = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_id"), F.col("user_id")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    temp = F.floor(F.col("value") * 10).cast("long") - 200
    signed = F.concat(F.when(temp < 0, "-").otherwise("+"), F.lpad(F.abs(temp).cast("string"), 4, "0"))
    temp_text = F.when(k == 99, "+9999").otherwise(signed)
    text = F.concat(
        F.lit("0165"), pad(u, 6), pad(u % 25, 5), F.date_format("ts", "yyyyMMddHHmm"), F.lit("4+41995-087934FM-15+0201ORD  V020"), pad(i * 37 % 360, 3), F.lit("1N"), pad(i % 800, 4), F.lit("1220001"),
        F.lit("9N"), pad(i * 7 % 160000, 6), F.lit("199"), temp_text, F.lit("1"), F.lit("+0150110132"), F.lit("1"),
        F.when(k % 4 == 0, F.concat(F.lit("ADDAA101"), pad(k % 40, 4), F.lit("91"))).when(k % 4 == 1, F.concat(F.lit("ADDAJ1"), pad(k, 4), F.lit("91GF1"), pad(k % 9, 2), F.lit("991"))).otherwise(""),
    )
    return e.select("event_id", text.alias("value"))


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-days from line items: each supplier's shipments of a date."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    q, pk = F.col("l_quantity"), F.col("l_partkey")
    days = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.sum(q).alias("n_temp_hours"), F.count("*").alias("n_reports"), F.avg(q).alias("q"), F.max(q).alias("qx"), F.min(q).alias("qn"), F.avg("l_discount").alias("disc"),
        F.avg((pk % 12).cast("double")).alias("wind_mean_ms"), F.avg((pk % 16000).cast("double")).alias("visibility_mean_m"), F.avg(990 + (pk % 50).cast("double")).alias("slp_mean_hpa"),
        F.avg(F.when(pk % 3 == 0, (pk % 9).cast("double"))).alias("sky_cover_mean_oktas"), F.max(F.when(pk % 5 == 0, (pk % 40).cast("double"))).alias("snow_depth_cm"),
        F.sum(F.col("l_tax") * 20).alias("rain"), F.count_if(F.col("l_tax") > 0.02).alias("n_precip_1h_reports"), F.max(F.when(pk % 4 == 0, F.col("l_tax"))).alias("precip_24h_mm"),
    )
    valid = F.col("n_temp_hours") >= 18
    met = days.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(
        _id(F.col("l_suppkey"), F.col("s_nationkey")).alias("station_id"), "day", valid.alias("valid_day"), F.col("n_reports"), *[F.when(valid, F.col(c) - 20).alias(n) for c, n in (("q", "temp_mean_c"), ("qx", "temp_max_c"), ("qn", "temp_min_c"))],
        (F.col("disc") * 200 - 5).alias("dewpoint_mean_c"), "wind_mean_ms", "visibility_mean_m", "slp_mean_hpa", "sky_cover_mean_oktas", "snow_depth_cm", F.when(valid, F.col("rain")).alias("precip_mm"), "n_precip_1h_reports", "precip_24h_mm",
    )


_stored: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """The application, the table, and the input as it is now: names, sizes and times of what lies in its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.sparkContext.applicationId, sf_dir, name, tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once per application and input, and read from the shared folder by all lookups;
    made anew where the input has changed."""
    key = _key(spark, sf_dir, name)
    if key not in _stored:
        _stored[key] = Scratch(spark, "lookup").save(name, make())
    return _stored[key]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per station."""
    return stored(spark, sf_dir, "features", lambda: station_features(station_days(spark, sf_dir), SPARSE))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "kept", lambda: keep_filter(with_stations(features(spark, sf_dir), stations(spark, sf_dir)), SPARSE))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id and z of the kept stations."""
    return stored(spark, sf_dir, "points", lambda: zscores(kept(spark, sf_dir), FEATURE_NAMES))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept stations with z, percentiles of features cut to five places, and a fixed grouping: their nation's number modulo 4."""

    def make() -> DataFrame:
        k = kept(spark, sf_dir)
        exact = k.select("station_id", *[(F.round(F.col(n) + 1.7e-8, 5) + 0.0).alias(n) for n in FEATURE_NAMES])
        group = F.substring("station_id", 8, 5).cast("int") % 4
        return k.withColumn("cluster", group).join(points(spark, sf_dir), "station_id").join(percentile_ranks(exact), "station_id")

    return stored(spark, sf_dir, "grouped", make)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "edges", lambda: neighbor_edges(points(spark, sf_dir), kept(spark, sf_dir), SPARSE))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-grams of the stations' names, stored in their order."""
    key = _key(spark, sf_dir, "search_index")
    if key not in _stored:
        path = f"{Scratch(spark, 'lookup').dir}/search_index"
        write_clustered(postings(search_text(stations(spark, sf_dir)), "station_id", "text"), path, "gram")
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
