"""Nearest places on the sphere by a hierarchical grid.

Directions are put on the six faces of a cube, and each face is halved in both directions on every
level, so cells have no poles and no date line. ``STEP`` levels at a time make a tree of up to 64
children a node, deep enough that a cell has few places. A node knows the box of its places in
space and one place in it. For a guess the distance to that place bounds the nearest from above, the
distance to the box (a chord, turned into miles) from below, so on each level a guess keeps the few
cells whose lower bound doesn't exceed the least upper bound, and meets only the places of those on
the last level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.config import Climate
from nimbora.functions.geo import haversine_mi
from nimbora.sources.scratch import Scratch

#: Levels of halving between two levels of the tree, and the deepest one (cells of half an inch).
STEP, DEEPEST = 3, 30
#: Bounds give way by this share and by this many miles, so that no rounding loses the nearest place.
SLACK, SLACK_MI = 1e-9, 1e-4
AXES = ("x", "y", "z")


def direction(lat: Column, lon: Column) -> list[Column]:
    """The point of the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def cell(x: Column, y: Column, z: Column, level: int) -> Column:
    """Number of the cell of a level: face, row, column."""
    n = 1 << level
    most = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    by = lambda a, b, c: F.when(F.abs(x) == most, a).when(F.abs(y) == most, b).otherwise(c)
    face = by(F.when(x > 0, 0).otherwise(1), F.when(y > 0, 2).otherwise(3), F.when(z > 0, 4).otherwise(5)).cast("long")
    at = lambda share: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor((share / most + 1) / 2 * n).cast("long")))
    return (face * n + at(by(y, x, x))) * n + at(by(z, z, y))


def parent(number: Column, level: int, up: int = STEP) -> Column:
    """The cell ``up`` levels above, which holds this one."""
    row, column = F.shiftright(number, level), number.bitwiseAND(F.lit((1 << level) - 1))  # the row with its face
    return F.shiftleft(F.shiftright(row, up), level - up) + F.shiftright(column, up)


def miles_to_box(point: list[Column], box: Column, c: Climate = Climate()) -> Column:
    """At most the distance over the sphere from a point of it to any point in a box (x1, x2, y1, ...)."""
    gap = lambda p, a: F.greatest(F.lit(0.0), box[a + "1"] - p, p - box[a + "2"])
    chord = F.sqrt(sum((gap(p, a) * gap(p, a) for p, a in zip(point, AXES, strict=True)), F.lit(0.0)))
    return F.lit(2 * c.earth_mi * (1 - SLACK)) * F.asin(F.least(F.lit(1.0), chord / 2)) - SLACK_MI


def _nodes(cells: DataFrame, number: Column) -> DataFrame:
    """(cell, node) by ``number``: the box of what is in it, and one place."""
    edges = [f(F.col(a + i)).alias(a + i) for a in AXES for i, f in (("1", F.min), ("2", F.max))]
    nodes = cells.groupBy(number.alias("cell")).agg(*edges, F.min(F.struct("lat", "lon")).alias("one"))
    return nodes.select("cell", F.struct("cell", *[a + i for a in AXES for i in "12"], F.col("one.lat").alias("lat"), F.col("one.lon").alias("lon")).alias("node"))


def _kept(nodes: Column, best: Column) -> Column:
    """The nodes that may hold the nearest place, of those with their bounds."""
    return F.transform(F.filter(nodes, lambda x: x["lb"] <= best), lambda x: x["cell"])


def nearest_places(guesses: DataFrame, places: DataFrame, leaf: int = 64, stats: bool = False) -> DataFrame:
    """(guess_id, station_id, distance_mi) of ``guesses`` (guess_id, lat, lon): the least distance, ties
    to the smaller id. Neither side is broadcast or collected; of places at one spot the smallest id
    takes part. ``leaf``: places of a cell, about. With ``stats`` also ``cells``, how many cells of
    the last level a guess met. Guesses and places without a position take no part."""
    store = Scratch(guesses.sparkSession, "sphere")
    known = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spots = store.save("spots", known.groupBy("lat", "lon").agg(F.min("station_id").alias("station_id")).select("*", *direction(F.col("lat"), F.col("lon"))))
    level, most = STEP, spots.count()
    while most > leaf and level < DEEPEST:
        most = spots.groupBy(cell(*map(F.col, AXES), level)).count().agg(F.max("count")).first()[0]
        level += 0 if most <= leaf else STEP
    at = spots.withColumn("cell", cell(*map(F.col, AXES), level))
    leaves = at.groupBy("cell").agg(F.collect_list(F.struct("lat", "lon", "station_id")).alias("places"))  # few in each, by the loop above
    last_nodes = _nodes(at.select("cell", "lat", "lon", *[F.col(a).alias(a + i) for a in AXES for i in "12"]), F.col("cell"))
    tree = [store.save(f"nodes{level}", last_nodes) if level > STEP else last_nodes]  # from the last level up; one level alone is read once
    for below in range(level, STEP, -STEP):
        tree.append(store.save(f"nodes{below - STEP}", _nodes(tree[-1].select("node.*"), parent(F.col("cell"), below))))
    g = guesses.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("guess_id", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    g = g.select("*", *direction(F.col("g_lat"), F.col("g_lon")))
    own = g.columns

    def bounded(nodes: Column) -> Column:
        return F.transform(nodes, lambda x: F.struct(x["cell"].alias("cell"), miles_to_box([F.col(a) for a in AXES], x).alias("lb"), haversine_mi(F.col("g_lat"), F.col("g_lon"), x["lat"], x["lon"]).alias("ub")))

    least = lambda nodes: F.array_min(F.transform(nodes, lambda x: x["ub"])) * (1 + SLACK) + SLACK_MI
    first = tree[-1].agg(F.collect_list("node").alias("nodes"))  # at most 6 * 64, whatever there is
    met = g.crossJoin(F.broadcast(first)).withColumn("nodes", bounded(F.col("nodes"))).withColumn("best", least("nodes"))
    met = met.withColumn("kept", _kept(F.col("nodes"), F.col("best"))).drop("nodes")
    for i, down in enumerate(range(2 * STEP, level + 1, STEP)):
        children = tree[-2 - i].groupBy(parent(F.col("cell"), down).alias("cell")).agg(F.collect_list("node").alias("nodes"))  # at most 64
        step = met.select(*own, "best", F.explode("kept").alias("cell")).join(children, "cell").withColumn("nodes", bounded(F.col("nodes")))
        step = step.withColumn("best", F.least("best", least("nodes"))).withColumn("nodes", F.filter("nodes", lambda x: x["lb"] <= F.col("best")))
        met = step.groupBy(*own).agg(F.min("best").alias("best"), F.flatten(F.collect_list("nodes")).alias("nodes"))  # children of the few kept cells
        met = store.save(f"kept{down}", met.withColumn("kept", _kept(F.col("nodes"), F.col("best"))).drop("nodes"))
    last = met.select("guess_id", "g_lat", "g_lon", F.explode("kept").alias("cell")).join(leaves, "cell")
    far = F.array_min(F.transform("places", lambda x: F.struct(haversine_mi(F.col("g_lat"), F.col("g_lon"), x["lat"], x["lon"]).alias("d"), x["station_id"].alias("station_id"))))
    best = last.select("guess_id", far.alias("m")).groupBy("guess_id").agg(F.min("m").alias("m"), F.count("*").alias("cells"))
    out = best.select("guess_id", F.col("m.station_id").alias("station_id"), F.col("m.d").alias("distance_mi"), "cells")
    return out if stats else out.drop("cells")
