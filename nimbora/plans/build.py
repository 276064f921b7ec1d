"""The whole build: observations and stations to stored tables that lookups read.

Tables under ``root``: hourly, daily, features, locations, neighbors, clusters, cluster_states,
cluster_traits, vectors (single precision), sweep, diagnostics, quantiles, correlation,
f_ratios, ablation, loadings; documents: stats, summary. Each is written before what rests on
it is read, so a lost executor costs part of one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, Climate
from nimbora.operators import clean as C
from nimbora.operators import cluster as K
from nimbora.operators import diagnostics as G
from nimbora.operators import features as E
from nimbora.operators.daily import daily_aggregate
from nimbora.operators.distance_ranks import quantiles
from nimbora.plans import api
from nimbora.sources.records import read_document, write_clustered, write_document, write_hourly, write_table

DIMS = len(FEATURE_NAMES)


@dataclass(frozen=True)
class Model:
    """Sizes of the model's part: group numbers tried, restarts, refits and neighbours of the signal."""

    ks: tuple[int, ...] = tuple(range(3, 13))
    least_k: int = 5
    restarts: int = 10
    final_restarts: int = 20
    mixtures: int = 3
    repeats: int = 25
    components: int = 5


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def build_features(observations: DataFrame, stations: DataFrame, root: str, c: Climate = Climate()) -> None:
    """hourly, daily and features (of all stations, with what is known of them), and the stats document."""
    spark = observations.sparkSession
    write_hourly(C.hour_collapse(C.clean(observations, c)), f"{root}/hourly")
    hourly = table(spark, root, "hourly")
    write_table(daily_aggregate(hourly, c), f"{root}/daily")
    write_table(E.with_stations(E.station_features(table(spark, root, "daily"), c), stations), f"{root}/features")
    write_stats(observations, root, c)


def write_stats(observations: DataFrame, root: str, c: Climate = Climate()) -> None:
    """One JSON document: rows in, dropped, collapsed and left, counters by variable and type, coverage."""
    spark = observations.sparkSession
    account = C.accounting(observations, c)
    features = table(spark, root, "features")
    lists = {
        "report_types": C.report_type_counts(observations), "qc_nulled": C.by_variable(account, "qc"), "range_nulled": C.by_variable(account, "range"), "clean_values": C.by_variable(account, "clean"),
        "totals": C.grand_totals(account), "percent_left": C.percent_left(account), "coverage_pct": E.coverage(features), "missing": E.missing_counts(features, c),
    }
    one = C.identity_holds(account, table(spark, root, "hourly"))
    kept = E.keep_filter(features, c)
    one = one.crossJoin(features.agg(F.count("*").alias("n_stations"))).crossJoin(kept.agg(F.count("*").alias("n_kept")))  # one row each
    for name, rows in lists.items():  # a row per variable, report type or feature
        one = one.crossJoin(rows.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name)))
    write_document(one, f"{root}/stats")


def build_model(root: str, spark: SparkSession, c: Climate = Climate(), m: Model = Model()) -> None:
    """Everything that rests on the kept stations: groups, components, locations, neighbours, diagnostics."""
    kept = E.keep_filter(table(spark, root, "features"), c)
    write_table(kept.join(E.zscores(kept), "station_id").join(E.percentile_ranks(kept), "station_id"), f"{root}/kept")
    kept = table(spark, root, "kept")
    points = kept.select("station_id", "z")
    write_table(E.vectors32(points), f"{root}/vectors", 1)

    tried = K.sweep(points, "station_id", "z", DIMS, list(m.ks), m.restarts, c.seed, m.mixtures)
    write_table(spark.createDataFrame(tried, "algorithm string, k int, silhouette double, calinski_harabasz double, inertia double, bic double"), f"{root}/sweep", 1)
    k = K.choose_k(tried, m.least_k)
    grouped = K.relabel(K.kmeans(kept, "z", k, m.final_restarts, c.seed), "annual_mean_temp_f").withColumnRenamed("label", "cluster")
    scores, ratios, loadings = K.principal_components(points, "station_id", "z", m.components)
    parts = scores.select("station_id", *[f"pc{i + 1}" for i in range(min(3, m.components))])
    write_table(grouped.join(parts, "station_id"), f"{root}/grouped")
    grouped = table(spark, root, "grouped")
    outline = G.silhouette_samples(grouped, "station_id", "z", "cluster", DIMS).select("station_id", "silhouette")
    write_clustered(grouped.join(outline, "station_id"), f"{root}/locations", "station_id")
    locations = table(spark, root, "locations")
    write_clustered(api.neighbor_edges(points, locations, c), f"{root}/neighbors", "station_id")

    write_table(api.cluster_summary(locations), f"{root}/clusters", 1)
    write_table(api.cluster_states(locations), f"{root}/cluster_states", 1)
    write_table(api.cluster_traits(locations), f"{root}/cluster_traits", 1)

    every = list(range(DIMS))
    variants = {"all": every} | {f"without {n}": [j for j in every if j != i] for i, n in enumerate(FEATURE_NAMES)} | {f"only {n}": [i] for i, n in enumerate(FEATURE_NAMES)}
    write_table(G.geo_signal(points, locations, "station_id", "z", DIMS, variants), f"{root}/diagnostics", 1)
    write_table(quantiles(points, "station_id", "z", [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9]), f"{root}/quantiles", 1)
    write_table(G.correlation(locations, FEATURE_NAMES), f"{root}/correlation", 1)
    write_table(G.f_ratio(locations, FEATURE_NAMES, "cluster"), f"{root}/f_ratios", 1)
    write_table(spark.createDataFrame(K.feature_ablation(points, "station_id", "z", FEATURE_NAMES, k, c.seed), "feature string, silhouette double, ari double"), f"{root}/ablation", 1)
    cells = [(f"pc{j + 1}", n, float(loadings[i, j])) for j in range(loadings.shape[1]) for i, n in enumerate(FEATURE_NAMES)]
    write_table(spark.createDataFrame(cells, "component string, feature string, loading double"), f"{root}/loadings", 1)

    stable = spark.createDataFrame(K.stability(points, "station_id", "z", DIMS, k, m.repeats, seed=c.seed), "kind string, mean double, deviation double")
    one = G.centroid_separation(locations, "z", "cluster", DIMS)
    one = one.withColumns({"k": F.lit(k), "explained_variance": F.array(*[F.lit(x) for x in ratios])})
    one = one.crossJoin(locations.agg(F.avg("silhouette").alias("silhouette"), *[F.avg(n).alias(f"mean_{n}") for n in FEATURE_NAMES], *[F.stddev_pop(n).alias(f"scale_{n}") for n in FEATURE_NAMES]))  # one row
    for name, rows in (("stability", stable), ("sweep", table(spark, root, "sweep")), ("geo_signal", table(spark, root, "diagnostics")), ("quantiles", table(spark, root, "quantiles")), ("f_ratios", table(spark, root, "f_ratios")), ("ablation", table(spark, root, "ablation"))):
        one = one.crossJoin(rows.agg(F.collect_list(F.struct("*")).alias(name)))  # bounded by the number of features and of group sizes
    write_document(one, f"{root}/summary")


def build(observations: DataFrame, stations: DataFrame, root: str, c: Climate = Climate(), m: Model = Model()) -> None:
    """All tables and documents of ``root``, from raw observations and the station list."""
    build_features(observations, stations, root, c)
    build_model(root, observations.sparkSession, c, m)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """The stats document; no row before it is built."""
    return read_document(spark, f"{root}/stats")


def diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """The diagnostics document; no row before it is built."""
    return read_document(spark, f"{root}/summary")
