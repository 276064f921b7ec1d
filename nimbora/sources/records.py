"""Sources and sinks: station history, fixed-width records, status reports, tables, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.config import MANDATORY, RECORD_LENGTH, SECTIONS

HISTORY = ["USAF", "WBAN", "STATION NAME", "CTRY", "STATE", "ICAO", "LAT", "LON", "ELEV(M)", "BEGIN", "END"]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The station history: every CSV column as a string, then named and cast; what can't be cast is null."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in HISTORY)).option("header", True).csv(path)
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    year = lambda c: F.substring(F.col(f"`{c}`"), 1, 4).try_cast("int")
    text = lambda c: F.col(f"`{c}`")
    return raw.select(
        F.concat(text("USAF"), F.lit("-"), text("WBAN")).alias("station_id"), text("USAF").alias("usaf"), text("WBAN").alias("wban"), text("STATION NAME").alias("name"),
        text("CTRY").alias("country"), text("STATE").alias("state"), text("ICAO").alias("icao"), number("LAT").alias("lat"), number("LON").alias("lon"), number("ELEV(M)").alias("elev_m"),
        year("BEGIN").alias("begin_year"), year("END").alias("end_year"),
    )


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, source_year): lines of Latin-1 text, also gzipped, one task per compressed file.

    The CSV reader with a separator that can't occur decodes Latin-1 before anything is
    sliced. The year is that of the file's folder.
    """
    read = spark.read.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").option("recursiveFileLookup", True)
    year = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})/[^/]*$", 1), F.lit("")).try_cast("int")
    return read.csv(list(paths)).select("value", year.alias("source_year")).filter(F.length("value") >= RECORD_LENGTH)


def parse_records(lines: DataFrame) -> DataFrame:
    """Lines of at least RECORD_LENGTH characters in ``value`` -> typed observations; other columns stay.

    One projection: slices, sentinels to null (before the cast), lenient casts, unit scaling.
    """

    def valued(text: Column, scale: float | None, sentinel: str | None) -> Column:
        text = F.nullif(text, F.lit(sentinel)) if sentinel else text
        return text.try_cast("double") / F.lit(scale) if scale else text

    def slice_(start: int, end: int) -> Column:
        return F.substring("value", start + 1, end - start)

    tail = F.substring(F.col("value"), RECORD_LENGTH + 1, 1 << 30)
    columns = {n: valued(slice_(a, b), scale, s) for n, a, b, scale, s in MANDATORY}
    columns |= {n: valued(F.nullif(F.regexp_extract(tail, p, 1), F.lit("")), scale, s) for n, p, scale, s in SECTIONS}
    moment = F.try_to_timestamp(columns.pop("datetime_raw"), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    station = F.concat(columns["usaf"], F.lit("-"), columns["wban"])
    rest = [c for c in lines.columns if c != "value"]
    return lines.filter(F.length("value") >= RECORD_LENGTH).select(*rest, *[c.alias(n) for n, c in columns.items()], moment.alias("obs_time"), station.alias("station_id"))


def ingest_summary(status: DataFrame) -> DataFrame:
    """(file, status, bytes) -> per status: files, bytes, and how many and which files are missing, by name.

    The names are put in order by range partitions, each of which makes a piece; only whole pieces
    meet in the row that lists them.
    """
    counts = status.groupBy("status").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("status") == "missing").cast("int").alias("n_missing"))
    pieces = missing_files(status).filter("file is not null").repartitionByRange("file").groupBy(F.spark_partition_id().alias("piece")).agg(F.sort_array(F.collect_list("file")).alias("names"))
    # Pieces hold ranges, so they stand in the order of their first names.
    names = pieces.agg(F.flatten(F.sort_array(F.collect_list("names"))).alias("names")).select(F.lit("missing").alias("of"), "names")
    met = counts.join(names, F.col("status") == F.col("of"), "left")
    return met.select("status", "n_files", "bytes", "n_missing", F.coalesce("names", F.array().cast("array<string>")).alias("missing"))


def missing_files(status: DataFrame) -> DataFrame:
    """(file) of the files that weren't there, a row each."""
    return status.filter(F.col("status") == "missing").select("file")


def write_ingest(status: DataFrame, root: str) -> None:
    """Two sinks: ``files``, a table partitioned by status, and ``summary``, its counts and missing files
    as a document. These come from the written files, so both tell of the same."""
    status.write.mode("overwrite").partitionBy("status").option("compression", "zstd").parquet(f"{root}/files")
    write_document(ingest_summary(status.sparkSession.read.schema(status.schema).parquet(f"{root}/files")), f"{root}/summary")


def write_hourly(hourly: DataFrame, path: str) -> None:
    """Station-hours by year, so that a reader of some years opens only those."""
    hourly.write.mode("overwrite").partitionBy("source_year").option("compression", "zstd").parquet(path)


def write_table(table: DataFrame, path: str, files: int = 0) -> None:
    """A Parquet table; ``files`` merges a small one into that many."""
    (table.coalesce(files) if files else table).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_clustered(table: DataFrame, path: str, key: str, group_kb: int = 1024) -> None:
    """A Parquet table for lookups of single keys: ranges of ``key`` in files, sorted, in small row groups
    with statistics and a Bloom filter, so that a reader of one key opens a row group or none."""
    options = {"compression": "zstd", "parquet.block.size": str(group_kb << 10), "parquet.page.row.count.limit": "1000", f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.adaptive.enabled#{key}": "true"}
    table.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").options(**options).parquet(path)


def write_document(rows: DataFrame, path: str) -> None:
    """A small nested result as JSON lines."""
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """A JSON document, a line an object or (``lines`` false) one over many lines; an absent one is
    an empty frame. Without a schema, the document's own is taken."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema or "value string")
    read = spark.read.option("multiLine", not lines)
    return (read.schema(schema) if schema else read).json(path)
