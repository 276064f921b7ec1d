"""Ranks and positions of rows by range partitions, so that no task sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.sources.scratch import Scratch


def grouped_ranks(rows: DataFrame, group: str, by: str) -> DataFrame:
    """(group, by, n, before, total): of each value of a group how many rows have it, how many of
    the group have a smaller one, and how many the group has.

    Equal values meet in a partial aggregation; distinct ones lie in range partitions of (group,
    value), so a hot group spreads over many tasks. What goes to the driver is a row per group and
    a row per partition.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(group, by).agg(F.count("*").alias("n"))
    spread = Scratch(spark, "ranks").save("spread", counts.repartitionByRange(F.col(group), F.col(by)).withColumn("_part", F.spark_partition_id()))
    sums = spread.groupBy(group, "_part").agg(F.sum("n").alias("n")).orderBy(group, "_part").collect()
    offsets, sofar, totals = [], {}, {}
    for r in sums:
        totals[r[0]] = totals.get(r[0], 0) + r["n"]
    for r in sums:
        offsets.append((r[0], r["_part"], sofar.get(r[0], 0), totals[r[0]]))
        sofar[r[0]] = sofar.get(r[0], 0) + r["n"]
    table = spark.createDataFrame(offsets, f"_g {rows.schema[group].dataType.simpleString()}, _p int, _before long, total long")
    w = Window.partitionBy(group, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    met = inside.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.select(group, by, "n", (F.col("before") + F.col("_before")).alias("before"), "total")


def holds(position: Column) -> Column:
    """Whether a row of ``grouped_ranks`` holds the 0-based position of its group."""
    return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
