"""The build year by year: one year's files replace that year's partitions and counters, nothing else.

``hourly`` and ``daily`` are partitioned by source year and bucketed by station, rows of a bucket in
the order of stations. Observations are dealt by station once, on the way in; every later key (hours,
days, features) contains the station, so days and features are made from the stored tables without
an exchange. ``counters`` and ``report_types`` have a row set per year that sums to the whole's.

Bucketing is known to the session's catalog, so tables are looked up through ``tables``, which
declares them over what lies under ``root``. A year's partitions are replaced when the write commits:
a failed write leaves the old ones. Local days that cross new year exist once per source year;
``merge_year_boundary``, which joins them, needs neighbouring years together and is refused here.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.config import Climate
from nimbora.operators import clean as C
from nimbora.operators import features as E
from nimbora.operators.daily import daily_aggregate
from nimbora.sources.records import write_clustered

YEAR = "source_year"
BUCKETED = ("hourly", "daily")


def _name(root: str, table: str) -> str:
    return f"nimbora_{hashlib.sha1(root.encode()).hexdigest()[:12]}_{table}"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _declare(spark: SparkSession, root: str, table: str, schema: str, buckets: int) -> str:
    """The table in the session's catalog; partitions that others have written are taken up."""
    name = _name(root, table)
    if not spark.catalog.tableExists(name):
        layout = f"CLUSTERED BY (station_id) SORTED BY (station_id) INTO {buckets} BUCKETS" if table in BUCKETED else ""
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({YEAR}) {layout} LOCATION '{root}/{table}'")
        if _exists(spark, f"{root}/{table}"):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def _replace(frame: DataFrame, root: str, table: str, years: list[int], buckets: int) -> DataFrame:
    """Write the partitions of ``years``; a year that ``frame`` has no rows of loses its partition."""
    spark = frame.sparkSession
    frame = frame.select(*[c for c in frame.columns if c != YEAR], YEAR)
    name = _declare(spark, root, table, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), buckets)
    had = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    try:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        frame.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", had)
    spark.catalog.refreshTable(name)
    return spark.table(name).filter(F.col(YEAR).isin(years))


def _forget(spark: SparkSession, root: str, table: str, years: list[int]) -> None:
    for year in years:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{YEAR}={year}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if spark.catalog.tableExists(_name(root, table)):
            spark.sql(f"ALTER TABLE {_name(root, table)} DROP IF EXISTS PARTITION ({YEAR}={year})")


def add_years(observations: DataFrame, root: str, c: Climate = Climate(), buckets: int = 64) -> list[int]:
    """Take in all reports of the source years that ``observations`` has; returns these years."""
    if c.merge_year_boundary:
        raise ValueError("days across new year can't be merged year by year; use build.build_features")
    spark = observations.sparkSession
    buckets = _layout(spark, root, buckets)
    counted = C.accounting(observations, c, [YEAR])
    _replace(counted.coalesce(1), root, "counters", [], buckets)
    _replace(observations.groupBy(YEAR, "report_type").agg(F.count("*").alias("n")).coalesce(1), root, "report_types", [], buckets)
    left = {r[YEAR]: r["left"] for r in observations.groupBy(YEAR).agg(F.count_if(C.kept_type(c)).alias("left")).collect()}  # a row per year
    years = sorted(left)
    placed = observations.repartition(buckets, "station_id")
    hours = _replace(C.hour_collapse(C.clean(placed, c)), root, "hourly", years, buckets)
    _replace(daily_aggregate(hours, c), root, "daily", years, buckets)
    for table in BUCKETED:
        _forget(spark, root, table, [y for y in years if not left[y]])
    return years


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all years that were taken in; buckets are known to the plan."""
    if not spark.catalog.tableExists(_name(root, name)):
        schema = spark.read.parquet(f"{root}/{name}").schema
        found = {f.name: f.dataType.simpleString() for f in schema}
        order = [n for n in found if n != YEAR] + [YEAR]
        _declare(spark, root, name, ", ".join(f"`{n}` {'int' if n == YEAR else found[n]}" for n in order), _layout(spark, root))
    return spark.table(_name(root, name))


def _layout(spark: SparkSession, root: str, buckets: int = 0) -> int:
    """How many buckets the tables have: what stands beside them, else ``buckets`` from now on."""
    if _exists(spark, f"{root}/layout"):
        return int(spark.read.text(f"{root}/layout").first()[0])
    spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(f"{root}/layout")
    return buckets


def features(spark: SparkSession, root: str, stations: DataFrame, c: Climate = Climate()) -> DataFrame:
    """The features of all stations from the days of all years, stored in the order of stations."""
    write_clustered(E.with_stations(E.station_features(table(spark, root, "daily"), c), stations), f"{root}/features", "station_id")
    return spark.read.parquet(f"{root}/features")


def account(spark: SparkSession, root: str) -> DataFrame:
    """The counters of all years as ``clean.accounting`` has them: one row."""
    counters = table(spark, root, "counters")
    return counters.agg(*[F.sum(n).alias(n) for n in counters.columns if n != YEAR])


def report_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "report_types").groupBy("report_type").agg(F.sum("n").alias("n"))
