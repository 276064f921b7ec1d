"""Lookups that answer with DataFrames: extremes, outliers, twins, similarity, guesses, summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, FEATURES, Climate
from nimbora.functions.clue import facts
from nimbora.functions.geo import distance_score, haversine_mi
from nimbora.operators.diagnostics import top_per_group
from nimbora.operators.distance_ranks import shares, similarity_of
from nimbora.operators.features import percentile_ranks
from nimbora.operators.metric import distances, knn
from nimbora.operators.pairs import squared
from nimbora.operators.sphere import nearest_places
from nimbora.operators.text_index import holders
from nimbora.sources.scratch import Scratch


def extremes(features: DataFrame, feature: str, direction: str = "high", k: int = 10) -> DataFrame:
    """The k stations with the greatest ("high") or else the smallest values."""
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature}")
    order = F.col(feature).desc() if direction == "high" else F.col(feature).asc()
    return features.orderBy(order, "station_id").limit(k)


def outliers(silhouettes: DataFrame, id_: str, k: int = 15) -> DataFrame:
    """The k least silhouettes, as rounded to 6 places: ties go by id."""
    return silhouettes.withColumn("silhouette", F.round("silhouette", 6)).orderBy("silhouette", id_).limit(k)


def search_text(stations: DataFrame) -> DataFrame:
    """``stations`` with what a search looks at, as ``text``."""
    return stations.withColumn("text", F.lower(F.concat_ws(" ", "name", "state", "station_id")))


def search(stations: DataFrame, text: str, k: int = 12, index: DataFrame | None = None) -> DataFrame:
    """First k stations whose name, state or id has the text, in any case; two characters at least.
    With an ``index`` (``text_index.postings`` of ``search_text``) only stations that have all n-grams of
    the text are looked at."""
    rows = stations.select("station_id", "name", "state")
    if len(text) < 2:
        return rows.limit(0)
    if index is not None:
        rows = rows.join(holders(index, "station_id", text.lower()), "station_id", "left_semi")
    found = search_text(rows).filter(F.col("text").contains(text.lower()))
    return found.select("station_id", "name", "state").orderBy("station_id").limit(k)


def neighbor_edges(points: DataFrame, places: DataFrame, c: Climate = Climate()) -> DataFrame:
    """(station_id, neighbor_id, rank, climate_distance, similarity_pct, geo_distance_mi)."""
    dims = len(FEATURE_NAMES)
    near = Scratch(points.sparkSession, "edges").save("near", knn(points, "station_id", "z", dims, c.neighbors))
    near = similarity_of(near, points, "station_id", "z")
    spot = lambda x: places.select(F.col("station_id").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    met = near.join(spot("a"), "a").join(spot("b"), "b")
    return met.select(F.col("a").alias("station_id"), F.col("b").alias("neighbor_id"), "rank", F.col("d").alias("climate_distance"), "similarity_pct", haversine_mi("lat_a", "lon_a", "lat_b", "lon_b", c).alias("geo_distance_mi"))


def twins(edges: DataFrame, places: DataFrame, least_mi: float = 1000.0, k: int = 20) -> DataFrame:
    """Neighbours far apart: the k closest in climate; both directions appear."""
    far = edges.filter(F.col("geo_distance_mi") >= least_mi).orderBy("climate_distance", "station_id", "neighbor_id").limit(k)
    side = lambda x: places.select(F.col("station_id").alias(x), F.col("name").alias(f"{x}_name"), F.col("state").alias(f"{x}_state"))
    named = far.withColumnsRenamed({"station_id": "a", "neighbor_id": "b"})
    return named.join(side("a"), "a").join(side("b"), "b")


def pair_similarity(points: DataFrame, places: DataFrame, a: str, b: str) -> DataFrame:
    """Climate distance, share of pairs at least as far apart, and miles, of two stations."""
    dims = len(FEATURE_NAMES)
    lo, hi = sorted((a, b))
    found = {r["station_id"]: r["z"] for r in points.filter(F.col("station_id").isin(lo, hi)).select("station_id", "z").collect()}
    spark = points.sparkSession
    if lo == hi or len(found) < 2:
        return spark.createDataFrame([], "a string, b string, climate_distance double, similarity_pct double, geo_distance_mi double")
    d = float(distances(np.array([found[lo]], float), np.array([found[hi]], float))[0, 0])  # summed as in the ranks
    limit = spark.createDataFrame([(lo, hi, d)], "a string, b string, climate_distance double")
    share = (100 * (1 - F.col("below") / F.col("total"))).alias("similarity_pct")
    one = limit.join(F.broadcast(shares(points, "station_id", "z", limit, "climate_distance").select("d", share)), F.col("climate_distance") == F.col("d"))  # one row
    spot = lambda x: places.select(F.col("station_id").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    met = one.join(spot("a"), "a").join(spot("b"), "b")
    return met.select("a", "b", "climate_distance", "similarity_pct", haversine_mi("lat_a", "lon_a", "lat_b", "lon_b").alias("geo_distance_mi"))


def guess_report(points: DataFrame, places: DataFrame, guesses: DataFrame, target: str | None = None) -> DataFrame:
    """Per guess: miles to the target (default: the first station), score, nearest station and its climate distance."""
    first = places.agg(F.min("station_id").alias("t")) if target is None else places.sparkSession.createDataFrame([(target,)], "t string")
    z = points.select(F.col("station_id").alias("zid"), "z")
    goal = places.join(F.broadcast(first), F.col("station_id") == F.col("t")).select("t", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).join(z, F.col("t") == F.col("zid")).select("t", "t_lat", "t_lon", F.col("z").alias("tz"))
    near = nearest_places(guesses, places).join(guesses.withColumnsRenamed({"lat": "g_lat", "lon": "g_lon"}), "guess_id").join(z, F.col("station_id") == F.col("zid"))
    met = near.crossJoin(F.broadcast(goal))  # the target is one row
    miles = F.round(haversine_mi("g_lat", "g_lon", "t_lat", "t_lon"), 6)
    return met.select("guess_id", F.col("t").alias("target"), miles.alias("distance_mi"), distance_score(miles).alias("score"), F.col("station_id").alias("nearest"), F.sqrt(squared(F.col("z"), F.col("tz"), len(FEATURE_NAMES))).alias("climate_distance"))


def guess_answer(locations: DataFrame, edges: DataFrame, guesses: DataFrame, target: str) -> DataFrame:
    """All that is told after a guess. ``locations`` has the features, pct_*, z and cluster of each
    place. Per guess: guess_id, target, distance_mi, score, nearest, same_cluster, climate_distance,
    similarity_pct; gaps (feature, label, unit, the values, percentiles and z of both places, z_gap;
    the widest gap first), facts of the target, and the target's neighbours.
    """
    spark, dims = locations.sparkSession, len(FEATURE_NAMES)
    goal = locations.filter(F.col("station_id") == target)
    near = nearest_places(guesses, locations).join(guesses.withColumnsRenamed({"lat": "g_lat", "lon": "g_lon"}), "guess_id")
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(FEATURES[n][0]).alias("label"), F.lit(FEATURES[n][1]).alias("unit"), F.col(n).alias("value"), F.col(f"pct_{n}").alias("percentile"), F.col("z")[i].alias("z")) for i, n in enumerate(FEATURE_NAMES)])
    mine = locations.select("station_id", "z", F.col("cluster").alias("n_cluster"), each.alias("n_cells"))
    his = goal.select(F.col("station_id").alias("t"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("z").alias("tz"), F.col("cluster"), each.alias("t_cells"), facts().alias("facts"))
    met = near.join(mine, "station_id").crossJoin(F.broadcast(his))  # the target is one row
    met = met.withColumn("d", F.sqrt(squared(F.col("z"), F.col("tz"), dims)))
    # A pair isn't nearer than itself, though its distance was summed in another order there.
    met = similarity_of(met.withColumn("limit", F.col("d") * (1 - 1e-12)), locations, "station_id", "z", "limit")
    gap = F.zip_with("n_cells", "t_cells", lambda n, t: F.struct((-F.abs(n["z"] - t["z"])).alias("order"), t["feature"].alias("feature"), t["label"].alias("label"), t["unit"].alias("unit"), n["value"].alias("guess_value"), t["value"].alias("target_value"), n["percentile"].alias("guess_percentile"), t["percentile"].alias("target_percentile"), F.abs(n["z"] - t["z"]).alias("z_gap")))
    miles = F.round(haversine_mi("g_lat", "g_lon", "t_lat", "t_lon"), 6)
    around = with_neighbors(edges.filter(F.col("station_id") == target), locations)
    around = around.agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "name", "state", "climate_distance", "similarity_pct", "geo_distance_mi"))).alias("neighbors"))  # at most as many as neighbours are kept
    met = met.crossJoin(F.broadcast(around))  # one row
    return met.select(
        "guess_id", F.col("t").alias("target"), miles.alias("distance_mi"), distance_score(miles).alias("score"), F.col("station_id").alias("nearest"), (F.col("n_cluster") == F.col("cluster")).alias("same_cluster"), "cluster",
        F.col("d").alias("climate_distance"), "similarity_pct", F.transform(F.array_sort(gap), lambda x: x.dropFields("order")).alias("gaps"), "facts", "neighbors",
    )


def location_answer(locations: DataFrame, edges: DataFrame, station_id: str) -> DataFrame:
    """One place with nested features, percentiles, z, coverage, its cluster and its neighbours; no
    row if it is unknown. ``locations`` as in ``guess_answer``, with the coverage columns. Both tables
    are asked for single keys only, so clustered ones (``write_clustered``) are hardly read."""
    one = locations.filter(F.col("station_id") == station_id)
    mine = edges.filter(F.col("station_id") == station_id)
    ids = [r[0] for r in mine.select("neighbor_id").collect()]  # as many as neighbours are kept
    around = with_neighbors(mine, locations.filter(F.col("station_id").isin(ids)))
    around = around.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "name", "state", "lat", "lon", "cluster", "climate_distance", "similarity_pct", "geo_distance_mi"))).alias("neighbors"))
    nested = {"features": F.struct(*FEATURE_NAMES), "percentiles": F.struct(*[F.col(f"pct_{n}").alias(n) for n in FEATURE_NAMES]), "z": F.struct(*[F.col("z")[i].alias(n) for i, n in enumerate(FEATURE_NAMES)]), "coverage": F.struct(*COVERAGE)}
    return one.join(around, "station_id", "left").select("station_id", "name", "state", "lat", "lon", "elev_m", "cluster", *[v.alias(k) for k, v in nested.items()], "neighbors")


COVERAGE = ["n_hourly_reports", "n_days_with_data", "n_valid_days", "valid_day_fraction", "first_day", "last_day", "n_years", "n_temp_days", "n_dewpoint_days", "n_wind_days", "n_visibility_days", "n_days_with_precip_report", "n_precip_24h_days"]


def location_rows(kept: DataFrame) -> DataFrame:
    """Public columns of all places, with features and percentiles flattened for tables."""
    exact = kept.select("station_id", "name", "state", "lat", "lon", "elev_m", "n_hourly_reports", "n_valid_days", F.col("first_day").cast("string").alias("first_day"), *[(F.round(F.col(n) + 1.7e-8, 5) + 0.0).alias(n) for n in FEATURE_NAMES])
    return exact.join(percentile_ranks(exact), "station_id")


def with_neighbors(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with what is known of the neighbour; an edge without a match stays."""
    known = [c for c in ("name", "state", "lat", "lon", "cluster") if c in places.columns]
    return edges.join(places.select(F.col("station_id").alias("neighbor_id"), *known), "neighbor_id", "left")


def feature_gaps(points: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, z_gap) between two stations."""
    side = lambda s, n: points.filter(F.col("station_id") == s).select(F.col("z").alias(n))
    met = side(a, "za").crossJoin(F.broadcast(side(b, "zb")))  # one row each
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.abs(F.col("za")[i] - F.col("zb")[i]).alias("z_gap")) for i, n in enumerate(FEATURE_NAMES)])
    return met.select(F.explode(cells).alias("x")).select("x.*")


def cluster_summary(grouped: DataFrame) -> DataFrame:
    """Per cluster: size, centre on the map, feature means, and mean squared distance to the centroid
    in z; mean z (z_*) too, and the mean silhouette where ``grouped`` has a column of it."""
    dims = len(FEATURE_NAMES)
    sums = grouped.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *[F.avg(n).alias(n) for n in FEATURE_NAMES],
        reduce(lambda a, b: a + b, [F.var_pop(F.col("z")[i]) for i in range(dims)]).alias("within_variance"),
        *[F.avg(F.col("z")[i]).alias(f"z_{n}") for i, n in enumerate(FEATURE_NAMES)], *([F.avg("silhouette").alias("silhouette")] if "silhouette" in grouped.columns else []),
    )
    return sums


def cluster_states(grouped: DataFrame, k: int = 6) -> DataFrame:
    n = grouped.groupBy("cluster", "state").agg(F.count("*").alias("n"))
    return top_per_group(n, "cluster", [F.col("n").desc(), F.col("state")], k)


def cluster_traits(grouped: DataFrame, k: int = 4) -> DataFrame:
    """(cluster, rank, trait): the features whose mean z is furthest from 0, in words."""
    means = grouped.groupBy("cluster").agg(*[F.avg(F.col("z")[i]).alias(n) for i, n in enumerate(FEATURE_NAMES)]).unpivot("cluster", FEATURE_NAMES, "feature", "z")
    label = F.create_map(*[x for n, (text, _, _) in FEATURES.items() for x in (F.lit(n), F.lit(text.lower()))])
    exact = means.withColumn("z", F.round("z", 9))
    top = top_per_group(exact, "cluster", [F.abs("z").desc(), F.col("feature")], k)
    side = F.when(F.col("z") > 0, "high ").otherwise("low ")
    return top.select("cluster", "rank", "feature", F.concat(side, label[F.col("feature")], F.lit(" ("), F.format_string("%+.1f", "z"), F.lit(" sd)")).alias("trait"))


def top_loadings(loadings: DataFrame, k: int = 4) -> DataFrame:
    """(component, feature, loading, rank) of the k greatest loadings of each component, by size."""
    return top_per_group(loadings, "component", [F.abs("loading").desc(), F.col("feature")], k)
