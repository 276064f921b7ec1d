"""One query per operator of the engine, over the analog inputs. Doubles are rounded, so
that sums taken in another order give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, PRECIP_FEATURES
from nimbora.functions import clue as clues
from nimbora.functions.geo import color_scale, distance_score, haversine_mi
from nimbora.operators import clean as C
from nimbora.operators import cluster as K
from nimbora.operators import daily as D
from nimbora.operators import diagnostics as G
from nimbora.operators import distance_ranks
from nimbora.operators import features as E
from nimbora.operators import metric as M
from nimbora.operators.pair_ranks import ranked_pairs
from nimbora.operators.sphere import nearest_places
from nimbora.plans import analogs as A
from nimbora.plans import api
from nimbora.plans import build as B
from nimbora.plans import yearly as Y
from nimbora.sources import records as R
from nimbora.sources.scratch import Scratch
from nimbora.streaming.rounds import OUT, outcomes

DIMS = len(FEATURE_NAMES)
GUESSES = [(float(lat), float(lon)) for lat in range(25, 50, 4) for lon in range(-124, -66, 8)]


def rounded(frame: DataFrame, places: int = 5) -> DataFrame:
    """Doubles rounded, without a negative zero; the nudge keeps decimal halves off the edge.
    Dates and times as text."""
    moments = ("date", "timestamp_ntz", "timestamp")
    one = lambda c, t: (F.round(F.col(c) + 1.7e-8, places) + 0.0).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t in moments else F.col(c)
    return frame.select(*[one(c, t) for c, t in frame.dtypes])


def _cleaned(spark, sf):
    return C.clean(A.observations(spark, sf), A.EVENTS)


def _hourly(spark, sf):
    return C.hour_collapse(_cleaned(spark, sf))


def station_select(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.select_stations(A.stations(spark, sf), A.SPARSE).select("station_id", "name", "state", "lat", "lon", "begin_year", "end_year"))


def fixed_width_parse(spark, sf):
    parsed = R.parse_records(A.lines(spark, sf))
    return rounded(parsed.select("event_id", "station_id", "obs_time", "lat", "lon", "report_type", "wind_dir", "wind_speed_ms", "visibility_m", "temp_c", "temp_qc", "dewpoint_c", "slp_hpa"))


def regex_sections(spark, sf):
    return rounded(R.parse_records(A.lines(spark, sf)).select("event_id", "precip_period_h", "precip_mm", "precip_qc", "snow_depth_cm", "snow_depth_qc", "sky_cover_oktas", "sky_cover_qc"))


def report_type_counts(spark, sf):
    return C.report_type_counts(A.observations(spark, sf))


def qc_null_counts(spark, sf):
    return C.by_variable(C.accounting(A.observations(spark, sf), A.EVENTS), "qc")


def range_null_counts(spark, sf):
    return C.by_variable(C.accounting(A.observations(spark, sf), A.EVENTS), "range")


def clean_value_counts(spark, sf):
    return C.by_variable(C.accounting(A.observations(spark, sf), A.EVENTS), "clean")


def cleaning_accounting(spark, sf):
    return C.identity_holds(C.accounting(A.observations(spark, sf), A.EVENTS), _hourly(spark, sf))


def hour_collapse(spark, sf):
    return rounded(_hourly(spark, sf))


def wind_vector_mean(spark, sf):
    return rounded(_hourly(spark, sf).select("source_year", "station_id", "hour", "wind_u", "wind_v").filter("wind_u is not null"))


def precip_period_max(spark, sf):
    return rounded(_hourly(spark, sf).select("source_year", "station_id", "hour", "precip_1h_mm", "precip_24h_mm"))


def local_day(spark, sf):
    h = _hourly(spark, sf)
    return rounded(h.groupBy(D.local_day(F.col("hour"), F.col("lon")).alias("day")).agg(F.count("*").alias("n_hours"), F.count_distinct("station_id").alias("n_stations")))


def daily_aggregate(spark, sf):
    return rounded(D.daily_aggregate(_hourly(spark, sf), A.EVENTS))


def valid_day_nulling(spark, sf):
    d = D.daily_aggregate(_hourly(spark, sf), A.EVENTS)
    return d.groupBy("valid_day").agg(F.count("*").alias("n_days"), F.count("temp_mean_c").alias("n_temp"), F.count("precip_mm").alias("n_precip"), F.count("dewpoint_mean_c").alias("n_dewpoint"))


def station_features(spark, sf):
    """Made anew, as it is the build that counts here; lookups read the stored table."""
    return rounded(E.station_features(A.station_days(spark, sf), A.SPARSE))


def precip_gauge_rule(spark, sf):
    return rounded(A.features(spark, sf).select("station_id", "n_days_with_precip_report", "n_valid_days", "has_precip_gauge", *PRECIP_FEATURES))


def coverage_pct(spark, sf):
    return E.coverage(A.features(spark, sf))


def missing_feature_counts(spark, sf):
    return E.missing_counts(A.features(spark, sf), A.SPARSE)


def features_join_stations(spark, sf):
    return rounded(E.with_stations(A.features(spark, sf), A.stations(spark, sf)).select("station_id", "name", "state", "lat", "lon", "elev_m", "n_valid_days", "annual_mean_temp_f"))


def keep_filter(spark, sf):
    return rounded(A.kept(spark, sf).select("station_id", "name", "valid_day_fraction"))


def zscore(spark, sf):
    z = A.points(spark, sf)
    return rounded(z.select("station_id", *[F.col("z")[i].alias(n) for i, n in enumerate(FEATURE_NAMES)]))


def percentile_rank(spark, sf):
    return rounded(E.percentile_ranks(A.kept(spark, sf)))


def pairwise_quantiles(spark, sf):
    return rounded(distance_ranks.quantiles(A.points(spark, sf), "station_id", "z", [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9]))


def knn10(spark, sf):
    edges = M.knn(A.vectors(spark, sf), "vec_id", "v", 64, 10)
    return rounded(edges.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbor_id"), "rank", F.col("d").alias("distance")))


def similarity_pct(spark, sf):
    return rounded(ranked_pairs(A.points(spark, sf), "station_id", "z"))


def neighbor_edges(spark, sf):
    """Made anew, like the features."""
    return rounded(api.neighbor_edges(A.points(spark, sf), A.kept(spark, sf), A.SPARSE))


def haversine_pairs(spark, sf):
    s = A.stations(spark, sf).select("station_id", "lat", "lon", "k")
    t = s.select(F.col("station_id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.col("k") - 1).alias("k2"))
    return rounded(s.join(t, F.col("k") == F.col("k2")).select("station_id", "other_id", haversine_mi("lat", "lon", "lat2", "lon2").alias("miles")))


def _guesses(spark):
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GUESSES)], "guess_id int, lat double, lon double")


def nearest_station(spark, sf):
    return rounded(nearest_places(_guesses(spark), A.stations(spark, sf)))


def distance_score_(spark, sf):
    return nearest_places(_guesses(spark), A.stations(spark, sf)).select("guess_id", distance_score(F.round(F.col("distance_mi"), 6)).alias("score"))


def _profiles(spark, sf):
    """Percentiles with the features' precision cut, so that no band hangs on a last bit."""
    kept = A.kept(spark, sf)
    exact = kept.select("station_id", "name", "state", "icao", *[(F.round(F.col(n) + 1.7e-8, 5) + 0.0).alias(n) for n in FEATURE_NAMES])
    return exact.join(E.percentile_ranks(exact), "station_id")


def climate_clue(spark, sf):
    return _profiles(spark, sf).select("station_id", clues.clue().alias("clue"))


def clue_facts(spark, sf):
    f = _profiles(spark, sf).select("station_id", F.explode(clues.facts()).alias("f"))
    return rounded(f.select("station_id", "f.feature", "f.label", "f.value", "f.unit", "f.percentile", "f.phrase"))


def clue_verify(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 1000 / F.lit(10.0)).alias("x"), "text")
    checked = clues.verify(d, "text", ["lang", "source"], F.array("x"))
    return checked.select("doc_id", "ok", F.size("problems").alias("n_problems"))


def extremes_high(spark, sf):
    return rounded(api.extremes(A.kept(spark, sf), "annual_mean_temp_f", "high").select("station_id", "annual_mean_temp_f"))


def extremes_low(spark, sf):
    return rounded(api.extremes(A.kept(spark, sf), "annual_precip_in", "low").select("station_id", "annual_precip_in"))


def _silhouettes(spark, sf):
    return G.silhouette_samples(A.vectors(spark, sf), "vec_id", "v", "label", 64)


def silhouette_samples(spark, sf):
    return rounded(_silhouettes(spark, sf))


def outliers(spark, sf):
    return rounded(api.outliers(_silhouettes(spark, sf), "vec_id"), 4)


def climate_twins(spark, sf):
    places = A.kept(spark, sf).select("station_id", "name", "state")
    return rounded(api.twins(A.edges(spark, sf), places, 500.0, 20).select("a", "b", "a_name", "b_name", "climate_distance", "geo_distance_mi"))


def pair_similarity(spark, sf):
    ids = [r["station_id"] for r in A.kept(spark, sf).select("station_id").orderBy("station_id").limit(2).collect()]
    if len(ids) < 2:
        ids = ["", ""]
    return rounded(api.pair_similarity(A.points(spark, sf), A.kept(spark, sf), ids[0], ids[1]))


def guess_report(spark, sf):
    return rounded(api.guess_report(A.points(spark, sf), A.kept(spark, sf), _guesses(spark)))


def location_profile(spark, sf):
    return rounded(api.location_rows(A.kept(spark, sf)))


def cluster_summary(spark, sf):
    g = A.grouped(spark, sf)
    s = G.silhouette_samples(g, "station_id", "z", "cluster", DIMS).select("station_id", "silhouette")
    return rounded(api.cluster_summary(g.join(s, "station_id")))


def cluster_states_top6(spark, sf):
    return api.cluster_states(A.grouped(spark, sf))


def cluster_traits_top4(spark, sf):
    return api.cluster_traits(A.grouped(spark, sf))


def calinski_harabasz(spark, sf):
    return rounded(G.calinski_harabasz(A.vectors(spark, sf), "v", "label", 64))


def adjusted_rand(spark, sf):
    labels = A.table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7).alias("other"))
    return rounded(G.adjusted_rand(labels, "label", "other"), 9)


def f_ratio(spark, sf):
    return rounded(G.f_ratio(A.grouped(spark, sf), FEATURE_NAMES, "cluster"))


def correlation_matrix(spark, sf):
    return rounded(G.correlation(A.kept(spark, sf), FEATURE_NAMES))


def geo_signal_5nn(spark, sf):
    return rounded(G.geo_signal(A.points(spark, sf), A.kept(spark, sf), "station_id", "z", DIMS), 4)


def geo_signal_ablation(spark, sf):
    every = list(range(DIMS))
    variants = {f"without {n}": [j for j in every if j != i] for i, n in enumerate(FEATURE_NAMES)} | {f"only {n}": [i] for i, n in enumerate(FEATURE_NAMES)}
    return rounded(G.geo_signal(A.points(spark, sf), A.kept(spark, sf), "station_id", "z", DIMS, variants), 3)


def centroid_separation(spark, sf):
    return rounded(G.centroid_separation(A.vectors(spark, sf), "v", "label", 64))


def latency_summary(spark, sf):
    e = A.table(spark, sf, "events")
    return G.latency_summary(e.select(F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")).alias("path"), F.col("value").alias("ms")))


def ingest_summary(spark, sf):
    o = A.table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 97 == 0, "missing").when(F.col("o_orderstatus") == "O", "cached").otherwise("downloaded")
    root = Scratch(spark, "ingest").dir
    R.write_ingest(o.select(F.col("o_orderkey").cast("string").alias("file"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("bytes")), root)
    s = R.read_document(spark, f"{root}/summary", "status string, n_files long, bytes long, n_missing int, missing array<string>")
    return s.withColumn("missing", F.array_join("missing", ","))


def missing_files(spark, sf):
    o = A.table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 97 == 0, "missing").otherwise("there")
    return R.missing_files(o.select(F.col("o_orderkey").cast("string").alias("file"), status.alias("status")))


def clipped_scale(spark, sf):
    k = A.kept(spark, sf).select("station_id", (F.round(F.col("annual_mean_temp_f") + 1.7e-8, 5) + 0.0).alias("x"))
    q = G.lower_quantiles(k, "x", [0.02, 0.98])
    met = k.crossJoin(F.broadcast(q))  # the right side is one row
    return rounded(met.select("station_id", color_scale(F.col("x"), F.col("q")[0], F.col("q")[1]).alias("shade")))


def station_search(spark, sf):
    """By the stored index of character n-grams, as typed."""
    return api.search(A.stations(spark, sf), "On_1", index=A.search_index(spark, sf))


def health(spark, sf):
    g = A.grouped(spark, sf)
    return g.agg(F.count("*").alias("locations"), F.count_distinct("cluster").alias("clusters"))


def kmeans_sweep(spark, sf):
    return spark.createDataFrame(K.sweep(A.vectors(spark, sf), "vec_id", "v", 64, list(range(3, 13))), "algorithm string, k int, silhouette double, calinski_harabasz double, inertia double, bic double")


def ward_labels(spark, sf):
    return K.ward(A.points(spark, sf), "station_id", "z", 4)


def gmm_bic(spark, sf):
    fit, bic = K.gaussian_mixture(A.vectors(spark, sf).select("vec_id", "v"), "v", 3, 64)
    return fit.groupBy("label").agg(F.count("*").alias("n")).withColumn("bic", F.lit(bic))


def pca_scores(spark, sf):
    return K.principal_components(A.points(spark, sf), "station_id", "z", 3)[0]


def stability_ari(spark, sf):
    return spark.createDataFrame(K.stability(A.vectors(spark, sf), "vec_id", "v", 64, 4), "kind string, mean double, deviation double")


def feature_ablation(spark, sf):
    names = [f"x{i}" for i in range(64)]
    return spark.createDataFrame(K.feature_ablation(A.vectors(spark, sf), "vec_id", "v", names, 4), "feature string, silhouette double, ari double")


def _first(spark, sf) -> str:
    """The station that reports are about: the first by id; none where none is kept."""
    row = A.kept(spark, sf).agg(F.min("station_id")).first()
    return row[0] or ""


def guess_answer(spark, sf):
    """The whole report of each guess, with the widest gap; its lists are told by the next two."""
    found = api.guess_answer(A.grouped(spark, sf), A.edges(spark, sf), _guesses(spark), _first(spark, sf))
    top = F.round(F.get("gaps", 0)["z_gap"] + 1.7e-8, 5) + 0.0
    return rounded(found.select("guess_id", "target", "distance_mi", "score", "nearest", "same_cluster", "cluster", "climate_distance", "similarity_pct", top.alias("widest_gap"), F.size("facts").alias("n_facts"), F.size("neighbors").alias("n_neighbors")))


def guess_gaps(spark, sf):
    found = api.guess_answer(A.grouped(spark, sf), A.edges(spark, sf), _guesses(spark), _first(spark, sf))
    return rounded(found.select("guess_id", F.explode("gaps").alias("g")).select("guess_id", "g.*"))


def feature_gaps(spark, sf):
    ids = [r[0] for r in A.kept(spark, sf).select("station_id").orderBy("station_id").limit(2).collect()] + ["", ""]
    return rounded(api.feature_gaps(A.points(spark, sf), ids[0], ids[1]))


def location_answer(spark, sf):
    one = api.location_answer(A.grouped(spark, sf), A.edges(spark, sf), _first(spark, sf))
    flat = [F.col("features")[n].alias(n) for n in FEATURE_NAMES] + [F.col("percentiles")[n].alias(f"pct_{n}") for n in FEATURE_NAMES] + [F.col("z")[n].alias(f"z_{n}") for n in FEATURE_NAMES]
    return rounded(one.select("station_id", "name", "state", "lat", "lon", "elev_m", "cluster", *flat, "coverage.n_valid_days", "coverage.n_years", "coverage.first_day", F.size("neighbors").alias("n_neighbors")))


def location_neighbors(spark, sf):
    one = api.location_answer(A.grouped(spark, sf), A.edges(spark, sf), _first(spark, sf))
    return rounded(one.select("station_id", F.explode("neighbors").alias("n")).select("station_id", "n.*"))


def describe_features(spark, sf):
    k = A.kept(spark, sf).select(*[(F.round(F.col(n) + 1.7e-8, 5) + 0.0).alias(n) for n in FEATURE_NAMES])
    return rounded(E.describe(k))


def counter_totals(spark, sf):
    return C.grand_totals(C.accounting(A.observations(spark, sf), A.EVENTS))


def percent_left(spark, sf):
    return C.percent_left(C.accounting(A.observations(spark, sf), A.EVENTS))


def vectors_float32(spark, sf):
    """Written in single precision and read back."""
    path = f"{Scratch(spark, 'vectors').dir}/z"
    R.write_table(E.vectors32(A.points(spark, sf)), path, 1)
    back = spark.read.parquet(path)
    return rounded(back.select("station_id", *[F.col("z")[i].cast("double").alias(n) for i, n in enumerate(FEATURE_NAMES)]), 4)


def history_csv(spark, sf):
    """The station list as the CSV file it comes in, read back."""
    path = f"{Scratch(spark, 'history').dir}/csv"
    s = A.stations(spark, sf)
    day = lambda c: F.concat(F.col(c).cast("string"), F.lit("0101"))
    raw = s.select(F.substring("station_id", 1, 6), F.substring("station_id", 8, 5), "name", "country", "state", "icao", F.col("lat").cast("string"), F.col("lon").cast("string"), F.when(F.col("k") % 3 == 0, "+bad").otherwise(F.col("elev_m").cast("string")), day("begin_year"), day("end_year"))
    raw.toDF(*R.HISTORY).write.option("header", True).csv(path)
    return rounded(R.read_history(spark, path).select("station_id", "usaf", "wban", "name", "country", "state", "icao", "lat", "lon", "elev_m", "begin_year", "end_year"))


def gzip_lines(spark, sf):
    """Records as gzipped Latin-1 text in folders by year, some lines too short, read back and parsed."""
    path = f"{Scratch(spark, 'lines').dir}/raw"
    lines = A.lines(spark, sf).join(A.table(spark, sf, "events").select("event_id", F.year("ts").alias("y")), "event_id")
    short = F.when(F.col("event_id") % 10 == 0, F.substring("value", 1, 104)).otherwise(F.col("value"))
    for y in [r[0] for r in lines.select("y").distinct().orderBy("y").collect()]:  # as many as there are years
        lines.filter(F.col("y") == y).select(short.alias("value")).write.option("compression", "gzip").text(f"{path}/{y}")
    parsed = R.parse_records(R.read_lines(spark, path))
    return rounded(parsed.groupBy("source_year", "station_id").agg(F.count("*").alias("n"), F.count("temp_c").alias("n_temp"), F.sum("wind_dir").alias("wind_dir"), F.min("obs_time").alias("first_time")))


def multi_line_json(spark, sf):
    """A document over many lines, read by its schema, beside one that isn't there."""
    path = Scratch(spark, "document").dir
    d = A.table(spark, sf, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    text = F.regexp_replace(F.to_json(F.struct("*")), ",", ",\n  ")
    d.select(text.alias("value")).coalesce(1).write.text(f"{path}/doc")
    schema = "nations array<struct<n_nationkey: int, n_name: string>>"
    both = R.read_document(spark, f"{path}/doc", schema, lines=False).union(R.read_document(spark, f"{path}/none", schema))
    return both.select(F.explode("nations").alias("n")).select("n.*")


def build_tables(spark, sf):
    """The build end to end, at its real sizes: (part, name, value) of what it writes, one value for each
    measure, pair of features, variant and quantile, and for columns of stations their sums. The
    model's part starts from the features of the station-days, as the events make too few days of
    one station. What hangs on a random start is told as rules that it keeps (``rule``: 1)."""
    root = Scratch(spark, "build").dir
    B.build_features(A.observations(spark, sf), A.stations(spark, sf), f"{root}/events", A.EVENTS)
    R.write_table(E.with_stations(A.features(spark, sf), A.stations(spark, sf)), f"{root}/model/features")
    B.build_model(f"{root}/model", spark, A.SPARSE)
    first, model = (lambda n: B.table(spark, f"{root}/events", n)), (lambda n: B.table(spark, f"{root}/model", n))

    def row(part: str, name, value):
        return F.struct(F.lit(part).alias("part"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value"))

    five = lambda x: F.round(x + 1.7e-8, 5)

    def told(frame: DataFrame, *cells) -> DataFrame:
        return frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*")

    def sums(part: str, frame: DataFrame, names: list[str]) -> DataFrame:
        whole = frame.agg(F.count("*").alias("rows"), *[F.sum(five(F.col(n))).alias(n) for n in names])
        return told(whole, row(part, "rows", F.col("rows")), *[row(part, n, F.col(n)) for n in names])

    pairs = first("hourly"), first("daily"), model("locations"), model("neighbors")
    out = sums("hourly", pairs[0], ["n_reports", "temp_c", "wind_u"]).union(sums("daily", pairs[1], ["n_hours", "temp_mean_c", "precip_mm"]))
    out = out.union(sums("features", first("features"), [])).union(sums("locations", pairs[2], FEATURE_NAMES + [f"pct_{n}" for n in FEATURE_NAMES]))
    out = out.union(sums("neighbors", pairs[3], ["rank", "climate_distance", "similarity_pct", "geo_distance_mi"]))
    out = out.union(sums("vectors", model("vectors").select(*[F.col("z")[i].cast("double").alias(n) for i, n in enumerate(FEATURE_NAMES)]), []))
    out = out.union(told(model("quantiles"), row("quantiles", F.format_string("%.2f", "p"), five(F.col("d")))))
    out = out.union(told(model("correlation"), row("correlation", F.concat_ws("|", "x", "y"), five(F.col("r")))))
    out = out.union(told(model("diagnostics"), row("geo_signal", F.col("variant"), F.round(F.when(F.col("variant") == "all", F.round(F.col("median_error_mi") + 1.7e-8, 4)).otherwise(F.round(F.col("median_error_mi") + 1.7e-8, 3)), 3))))
    stats = B.stats(spark, f"{root}/events")
    out = out.union(told(stats, *[row("stats", n, F.col(n)) for n in ("n_raw", "n_dropped", "n_collapsed", "n_clean", "n_stations")]))
    for field in ("qc_nulled", "range_nulled", "clean_values"):
        out = out.union(told(stats.select(F.explode(field).alias("v")), row(field, F.col("v.variable"), F.col("v.n"))))
    return rounded(out.union(_rules(spark, model, B.diagnostics(spark, f"{root}/model"))), 4)


def _rules(spark, model, summary) -> DataFrame:
    """(part, name, value) of rules that the model keeps, whatever its starts: clusters by mean temperature,
    the number of groups of the best silhouette, parts that sum to wholes, documents that repeat tables."""
    groups = {r["cluster"]: r for r in model("locations").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("annual_mean_temp_f").alias("t"), F.avg("silhouette").alias("s")).collect()}  # a row per cluster
    tried, one = [r.asDict() for r in model("sweep").collect()], summary.first()  # a row per algorithm and k
    best = max((r for r in tried if r["algorithm"] == "kmeans" and r["k"] >= B.Model().least_k), key=lambda r: (round(r["silhouette"], 12), -r["k"]))
    told = {r["cluster"]: r for r in model("clusters").collect()}
    lengths = {r["component"]: r["s"] for r in model("loadings").groupBy("component").agg(F.sum(F.col("loading") * F.col("loading")).alias("s")).collect()}
    share = [one["explained_variance"][i] for i in range(len(one["explained_variance"]))]
    near = lambda a, b: abs(a - b) < 1e-9 * max(1, abs(a))
    rules = {
        "clusters by mean temperature": [groups[g]["t"] for g in sorted(groups)] == sorted(groups[g]["t"] for g in groups) and sorted(groups) == list(range(one["k"])),
        "k of the best silhouette": one["k"] == best["k"], "sweep tries all": sorted((r["algorithm"], r["k"]) for r in tried) == sorted((a, k) for a in {r["algorithm"] for r in tried} for k in B.Model().ks) and len(tried) == 30,
        "summaries of clusters": all(told[g]["size"] == groups[g]["n"] and near(told[g]["silhouette"], groups[g]["s"]) and near(told[g]["annual_mean_temp_f"], groups[g]["t"]) for g in groups),
        "loadings have length 1": len(lengths) == B.Model().components and all(near(v, 1.0) for v in lengths.values()), "variance falls": share == sorted(share, reverse=True) and 0 < sum(share) <= 1 + 1e-9,
        "stability between -1 and 1": sorted(s["kind"] for s in one["stability"]) == ["noise", "subsample"] and all(-1 <= s["mean"] <= 1 and s["deviation"] >= 0 for s in one["stability"]),
        "ablation of each feature": sorted(a["feature"] for a in one["ablation"]) == sorted(FEATURE_NAMES), "f ratios of each feature": sorted(a["feature"] for a in one["f_ratios"]) == sorted(FEATURE_NAMES) and all(a["f"] is None or a["f"] >= 0 for a in one["f_ratios"]),
        "document repeats the sweep": sorted((r["algorithm"], r["k"]) for r in one["sweep"]) == sorted((r["algorithm"], r["k"]) for r in tried), "document repeats the signal": len(one["geo_signal"]) == model("diagnostics").count() and len(one["quantiles"]) == model("quantiles").count(),
    }
    return spark.createDataFrame([("rule", k, float(v)) for k, v in rules.items()], "part string, name string, value double")


def incremental_build(spark, sf):
    """Two years, one of them with a part of its files only, then that one whole and a third: a row per
    year of what the stored tables and counters hold, as if built at once."""
    root = Scratch(spark, "yearly").dir
    every = A.observations(spark, sf, 3)
    years = [r[0] for r in every.select("source_year").distinct().orderBy("source_year").collect()]  # three
    Y.add_years(every.filter((F.col("source_year") == years[0]) | ((F.col("source_year") == years[1]) & (F.col("event_id") % 2 == 0))), root, A.EVENTS, 4)
    Y.add_years(every.filter(F.col("source_year") > years[0]), root, A.EVENTS, 4)
    hours = Y.table(spark, root, "hourly").groupBy("source_year").agg(F.count("*").alias("n_hours"), F.sum("n_reports").alias("n_reports"), F.sum("temp_c").alias("temp_c"), F.count_distinct("station_id").alias("n_stations"))
    days = Y.table(spark, root, "daily").groupBy("source_year").agg(F.count("*").alias("n_days"), F.count_if(F.col("valid_day")).alias("n_valid"), F.sum("temp_mean_c").alias("temp_mean_c"))
    counters = Y.table(spark, root, "counters").select("source_year", "n_raw", "n_dropped", *[f"{k}_{n}" for n in ("temp_c", "visibility_m") for k in ("raw", "qc", "range", "clean")])
    types = Y.table(spark, root, "report_types").groupBy("source_year").agg(F.count("*").alias("n_types"))
    return rounded(hours.join(days, "source_year").join(counters, "source_year").join(types, "source_year"))


def round_outcomes(spark, sf):
    """The table of events replayed as a stream: a view opens a player's round, a click within six hours answers it
    (guess -1: none did)."""
    path, root = f"{sf}/events.parquet", Scratch(spark, "rounds").dir
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")  # a pattern may be a file or a folder
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "guess")
    played = outcomes(stream.select(F.col("user_id").cast("long").alias("player"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"), "ts"), 6 * 3600.0, "0 seconds")
    played.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return rounded(spark.read.schema(OUT).parquet(f"{root}/out").withColumn("guess_id", F.coalesce("guess_id", F.lit(-1).cast("long"))))


def queries() -> dict:
    found = [
        station_select, fixed_width_parse, regex_sections, report_type_counts, qc_null_counts, range_null_counts, clean_value_counts, cleaning_accounting, hour_collapse, wind_vector_mean, precip_period_max,
        local_day, daily_aggregate, valid_day_nulling, station_features, precip_gauge_rule, coverage_pct, missing_feature_counts, features_join_stations, keep_filter, zscore, percentile_rank,
        pairwise_quantiles, knn10, similarity_pct, neighbor_edges, haversine_pairs, nearest_station, distance_score_, climate_clue, clue_facts, clue_verify, extremes_high, extremes_low, outliers, climate_twins,
        pair_similarity, guess_report, location_profile, cluster_summary, cluster_states_top6, cluster_traits_top4, silhouette_samples, calinski_harabasz, adjusted_rand, f_ratio, correlation_matrix,
        geo_signal_5nn, geo_signal_ablation, centroid_separation, latency_summary, ingest_summary, missing_files, incremental_build, round_outcomes, clipped_scale, station_search, health, kmeans_sweep, ward_labels, gmm_bic, pca_scores, stability_ari, feature_ablation,
        guess_answer, guess_gaps, feature_gaps, location_answer, location_neighbors, describe_features, counter_totals, percent_left, vectors_float32, history_csv, gzip_lines, multi_line_json, build_tables,
    ]
    return {f.__name__.rstrip("_"): f for f in found}
