"""The engine against hand-made records: parsing, cleaning, days, scores, and the traps of each."""

import gzip
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, Climate
from nimbora.functions.clue import verify
from nimbora.functions.geo import color_scale, distance_score, haversine_mi
from nimbora.operators import clean as C
from nimbora.operators import cluster as K
from nimbora.operators import diagnostics as G
from nimbora.operators import fits as V
from nimbora.operators import pairs as P
from nimbora.operators.ranks import grouped_ranks
from nimbora.operators.daily import daily_aggregate, local_day
from nimbora.operators.features import percentile_ranks, station_features, zscores
from nimbora.plans import api
from nimbora.plans import build as B
from nimbora.plans import queries as Q
from nimbora.sources import records as R


def record(day=2, hour=6, temp="+0215", qc="1", kind="FM-15", tail="", stamp=None, lon="-087934"):
    head = "0165" + "725300" + "94846" + (stamp or f"202001{day:02d}{hour:02d}00") + "4" + "+41995" + lon + kind.ljust(5) + "+0201" + "ORD  " + "V020"
    return head + "2701N00461" + "2200019N" + "0160931" + "99" + temp + qc + "+01501" + "101321" + tail


#: The 24 hours of one local day at longitude -87.934: 06 to 05 UTC.
HOURS = [(2, h) for h in range(6, 24)] + [(3, h) for h in range(6)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "2020"
    path.mkdir()
    lines = [record(d, h) for d, h in HOURS] + [record(kind="SOD"), record(qc="3"), record(temp="+0800"), "short"]
    with gzip.open(path / "725300-94846-2020.gz", "wt", encoding="latin-1") as f:
        f.write("\n".join(lines))
    return str(path.parent)


def parsed(spark, *lines):
    return R.parse_records(spark.createDataFrame([(x, 2020) for x in lines], "value string, source_year int"))


def test_record_is_105_characters():
    assert len(record()) == 105


def test_mandatory_and_precipitation(spark):
    r = parsed(spark, record(tail="ADDAA101002591")).first()
    assert (r.temp_c, r.dewpoint_c, r.slp_hpa, r.wind_speed_ms, r.lat, r.lon) == (21.5, 15.0, 1013.2, 4.6, 41.995, -87.934)
    assert (r.precip_period_h, r.precip_mm, r.precip_qc, r.report_type, r.station_id) == (1.0, 2.5, "1", "FM-15", "725300-94846")
    assert str(r.obs_time) == "2020-01-02 06:00:00"


def test_sentinels_bad_times_and_letters_are_null(spark):
    r = parsed(spark, record(temp="+9999", stamp="20201399xx00", tail="ADDAA10100259A")).first()
    assert r.temp_c is None and r.obs_time is None and r.precip_mm is None


def test_latin1_gzip_and_year_of_folder(spark, tmp_path):
    (tmp_path / "2019").mkdir()
    with gzip.open(tmp_path / "2019" / "a.gz", "wb") as f:
        f.write((record() + 'REM "caf\xe9" \\ # \t ').encode("latin-1") + b"\n")
    r = R.read_lines(spark, str(tmp_path)).first()
    assert r.source_year == 2019 and r.value.endswith('"caf\xe9" \\ # \t ') and len(r.value) == 105 + len("REM") + 14


def test_cleaning_counts_everything(spark, folder):
    raw = R.parse_records(R.read_lines(spark, folder))
    a = C.accounting(raw).first()
    assert (a.n_raw, a.n_dropped, a.qc_temp_c, a.range_temp_c, a.raw_temp_c, a.clean_temp_c) == (27, 1, 1, 1, 26, 24)
    hours = C.hour_collapse(C.clean(raw))
    assert hours.count() == 24
    six = hours.filter("hour = timestamp_ntz'2020-01-02 06:00:00'").first()
    assert six.temp_c == 21.5 and six.n_reports == 3
    assert C.identity_holds(C.accounting(raw), hours).first().holds


def test_padded_type_never_matches(spark):
    kept = C.clean(parsed(spark, record(kind="SAO"), record(kind="SAOSP"))).collect()
    assert [r.report_type for r in kept] == ["SAOSP"]


def test_days_need_enough_hours(spark):
    full = C.hour_collapse(C.clean(parsed(spark, *[record(d, h) for d, h in HOURS])))
    r = daily_aggregate(full).collect()
    assert len(r) == 1 and r[0].valid_day and r[0].temp_mean_c == pytest.approx(21.5) and r[0].precip_mm == 0.0
    few = daily_aggregate(C.hour_collapse(C.clean(parsed(spark, *[record(d, h) for d, h in HOURS[:10]])))).first()
    assert not few.valid_day and few.temp_mean_c is None and few.precip_mm is None and few.dewpoint_mean_c is not None


def test_solar_day_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(-97.5,), (-67.5,), (-90.0,)], "lon double").select("lon", F.lit("2020-01-02 05:30:00").cast("timestamp_ntz").alias("hour"))
    days = {r.lon: str(r.day) for r in frame.select("lon", local_day(F.col("hour"), F.col("lon")).alias("day")).collect()}
    assert days == {-97.5: "2020-01-01", -67.5: "2020-01-02", -90.0: "2020-01-01"}


def test_year_boundary_is_a_key_unless_merged(spark):
    lines = [(record(stamp=f"20191231{h:02d}00"), 2019) for h in range(6, 24)] + [(record(stamp=f"20200101{h:02d}00"), 2020) for h in range(6)]
    hours = C.hour_collapse(C.clean(R.parse_records(spark.createDataFrame(lines, "value string, source_year int"))))
    assert sorted((r.source_year, r.n_hours) for r in daily_aggregate(hours).collect()) == [(2019, 18), (2020, 6)]
    assert [r.n_hours for r in daily_aggregate(hours, Climate(merge_year_boundary=True)).collect()] == [24]


def test_station_without_valid_days(spark):
    few = daily_aggregate(C.hour_collapse(C.clean(parsed(spark, record()))))
    r = station_features(few).first()
    assert r.n_valid_days == 0 and r.hot_days_per_year is None and r.has_precip_gauge and r.summer_precip_fraction is None


def test_scores_and_distances(spark):
    row = spark.createDataFrame([(0.0,), (15.0,), (100.0,), (1000.0,), (20000.0,)], "d double").select(distance_score(F.col("d")).alias("s")).collect()
    s = [r.s for r in row]
    assert s[:2] == [5000, 5000] and s == sorted(s, reverse=True) and s[-1] == 0
    one = spark.range(1).select(haversine_mi(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"), color_scale(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("c")).first()
    assert one.d == pytest.approx(3958.8 * math.pi) and one.c == 1.0


def test_zscores_ranks_and_ties(spark):
    rows = [(f"s{i}", *[float(v)] * len(FEATURE_NAMES)) for i, v in enumerate([1, 2, 3, 6])]
    frame = spark.createDataFrame(rows, ["station_id", *FEATURE_NAMES])
    z = {r.station_id: r.z[0] for r in zscores(frame).collect()}
    assert z["s0"] == pytest.approx(-2 / np.std([1, 2, 3, 6]))
    flat = zscores(spark.createDataFrame([(f"s{i}", *[4.0] * len(FEATURE_NAMES)) for i in range(3)], ["station_id", *FEATURE_NAMES]))
    assert all(r.z[0] == 0 for r in flat.collect())
    tied = spark.createDataFrame([(f"s{i}", *[float(v)] * len(FEATURE_NAMES)) for i, v in enumerate([1, 1, 2, 3])], ["station_id", *FEATURE_NAMES])
    assert {r.station_id: r[1] for r in percentile_ranks(tied).collect()} == {"s0": 37.5, "s1": 37.5, "s2": 75.0, "s3": 100.0}


def blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return x, np.repeat([0, 1, 2], 15), spark.createDataFrame([(i, [float(a) for a in v], int(i // 15)) for i, v in enumerate(x)], "id long, v array<double>, label int")


def test_diagnostics_equal_numpy(spark):
    x, y, frame = blobs(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i][(y == y[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i][y == k].mean() for k in range(3) if k != y[i])
        s.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in G.silhouette_samples(frame, "id", "v", "label", 2).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(s)
    c = np.array([x[y == k].mean(0) for k in range(3)])
    w = sum(((x[y == k] - c[k]) ** 2).sum() for k in range(3))
    b = sum(15 * ((c[k] - x.mean(0)) ** 2).sum() for k in range(3))
    assert G.calinski_harabasz(frame, "v", "label", 2).first().calinski_harabasz == pytest.approx((b / 2) / (w / 42))
    pairs = np.sort(d[np.triu_indices(len(x), 1)])
    sim = {(r.a, r.b): r.similarity_pct for r in P.similarity(P.all_pairs(frame, "id", "v", 2)).collect()}
    assert len(sim) == len(pairs)
    assert sim[(0, 1)] == pytest.approx(100 * (1 - np.searchsorted(pairs, d[0, 1] - 1e-12) / len(pairs)))


def test_models_find_blobs(spark):
    x, y, frame = blobs(spark)
    for labelled in (K.kmeans(frame.drop("label"), "v", 3, 3), K.gaussian_mixture(frame.drop("label"), "v", 3, 2)[0], frame.drop("label").join(K.ward(frame, "id", "v", 3), "id")):
        got = labelled.select("id", F.col("label").alias("fit")).join(frame.select("id", "label"), "id")
        assert G.adjusted_rand(got, "fit", "label").first().ari == pytest.approx(1)
    scores, ratio, loadings = K.principal_components(frame, "id", "v", 2)
    assert sum(ratio) == pytest.approx(1) and (loadings[np.abs(loadings).argmax(0), [0, 1]] > 0).all()
    with pytest.raises(ValueError):
        K.ward(frame, "id", "v", 3, most=10)


def test_mixture_of_many_dimensions(spark):
    """Densities of 64 dimensions leave the range of a double; a group may have fewer rows than dimensions."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, s, (40, 64)) + c for c, s in ((0, 1e-3), (3, 0.1), (-40, 1))])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>").repartition(3)
    got, bic = K.gaussian_mixture(frame, "v", 3, 64)
    labels = [r.label for r in got.orderBy("id").collect()]
    assert [len(set(labels[i : i + 40])) for i in (0, 40, 80)] == [1, 1, 1] and len(set(labels)) == 3
    want = -2 * sum(
        -0.5 * (np.linalg.slogdet(c)[1] + 64 * math.log(2 * math.pi) + d @ np.linalg.solve(c, d)) + math.log(1 / 3)
        for part in (x[:40], x[40:80], x[80:]) for c in [np.cov(part.T, bias=True) + 1e-6 * np.eye(64)] for d in part - part.mean(0)
    ) + (2 + 3 * 64 + 3 * 64 * 65 / 2) * math.log(120)
    assert bic == pytest.approx(want, rel=1e-6)


def test_sweep_takes_whole_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(K, "sweep", lambda points, id_, vector, dims, ks, **more: seen.update(n=points.count(), dims=dims, sizes={len(r[0]) for r in points.select(vector).collect()}, ks=ks, more=more) or [])
    Q.kmeans_sweep(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert seen == {"n": n, "dims": 64, "sizes": {64}, "ks": list(range(3, 13)), "more": {}}


def test_fitted_models_take_whole_vectors(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.001", []

    def note(points, *rest, **more):
        seen.append((points.count(), {len(r.v) for r in points.select("v").collect()}, rest, more))
        return []

    monkeypatch.setattr(K, "gaussian_mixture", lambda points, *rest, **more: note(points, *rest, **more) or (points.withColumn("label", F.lit(0)), 0.0))
    monkeypatch.setattr(K, "stability", note)
    monkeypatch.setattr(K, "feature_ablation", note)
    for q in (Q.gmm_bic, Q.stability_ari, Q.feature_ablation):
        q(spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert [s[:2] for s in seen] == [(n, {64})] * 3
    assert [s[2] for s in seen] == [("v", 3, 64), ("vec_id", "v", 64, 4), ("vec_id", "v", [f"x{i}" for i in range(64)], 4)]
    assert all(s[3] == {} for s in seen)  # the operators' own restarts and repeats


def test_sweep_goes_on_where_ward_refuses(spark):
    _, _, frame = blobs(spark)
    rows = K.sweep(frame.drop("label"), "id", "v", 2, [3], restarts=2, mixtures=1, most=10)
    assert [(r[0], r[1]) for r in rows] == [("kmeans", 3), ("ward", 3), ("gmm", 3)]
    assert rows[1][2:] == (None, None, None, None) and rows[0][2] > 0.5 and rows[2][5] is not None
    assert all(r[2] > 0.5 for r in K.sweep(frame.drop("label"), "id", "v", 2, [3], restarts=2, mixtures=1))


def test_clue_check_and_lookups(spark):
    rows = [("It is 21 degrees in Chicago", "Chicago Ohare", "IL", 21.4), ("chicago is 7 off", "chicago", "IL", 21.4), ("about 21.4 and IL", "x", "IL", 21.4)]
    frame = spark.createDataFrame(rows, "text string, name string, state string, v double")
    assert [r.ok for r in verify(frame, "text", ["name", "state"], F.array("v")).collect()] == [True, False, True]
    with pytest.raises(ValueError):
        api.extremes(frame, "nothing")
    stations = spark.createDataFrame([("1", "Oak Park", "IL")], "station_id string, name string, state string")
    assert api.search(stations, "k pA").count() == 1 and api.search(stations, "k").count() == 0


def test_clue_verify_reads_whole_texts(spark, tmp_path):
    """Held against brute force: what stands after 300 characters counts too."""
    long = "word " * 100
    docs = [
        (1, long + "from WEB in 12.3 or 77 and -4", "en", "web", 123), (2, long + "only 12.3 and 12", "de", "Crawl ", 123), (3, "crawl 5", "deu", "crawl", 50), (4, long + "deu " + long + "9", "deu", None, 1090),
        (5, "", "en", "web", 0), (6, None, "en", "web", 7), (7, long * 50 + "0.7 1 2", "en", "web", 7),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def wrong(text, tokens, x):
        near = {float(round(x, 0)), float(round(x, 1))}
        told = [t for t in ((t or "").strip().lower() for t in tokens) if len(t) >= 3 and t in text.lower()]
        return len(told) + sum(not {float(n), float(round(float(n)))} & near for n in re.findall(r"-?\d+(?:\.\d+)?", text))

    got = {r.doc_id: (r.ok, r.n_problems) for r in Q.clue_verify(spark, str(tmp_path)).collect()}
    for i, text, lang, source, n in docs:
        if text is not None:
            many = wrong(text, (lang, source), n % 1000 / 10)
            assert got[i] == (many == 0, many), i
    assert got[1][1] == 3 and got[2] == (True, 0) and got[4][1] == 1


def test_latency_and_documents(spark, tmp_path):
    log = spark.createDataFrame([(f"/api/round/{i}a", float(i)) for i in range(1, 11)], "path string, ms double")
    r = G.latency_summary(log).first()
    assert (r.endpoint, r.n, r.p50, r.p95, r["max"]) == ("/api/round/{id}", 10, 6.0, 10.0, 10.0)
    assert R.read_document(spark, str(tmp_path / "none"), "a int").collect() == []
    R.write_document(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), str(tmp_path / "doc"))
    assert R.read_document(spark, str(tmp_path / "doc"), "a int, b array<int>").first().b == [2, 3]
    R.write_hourly(spark.createDataFrame([(2020, 1), (2021, 2)], "source_year int, x int"), str(tmp_path / "hourly"))
    plan = spark.read.parquet(str(tmp_path / "hourly")).filter("source_year = 2021")
    assert plan.first().x == 2 and len(plan.inputFiles()) == 2


def test_history_and_selection(spark, tmp_path):
    (tmp_path / "h.csv").write_text('USAF,WBAN,STATION NAME,CTRY,STATE,ICAO,LAT,LON,ELEV(M),BEGIN,END\n"725300","94846","CHICAGO","US","IL","KORD","+41.995","-087.934","+0201.8","19461001","20250101"\n"1","2","X","US","","","","bad","","","2024"\n')
    h = R.read_history(spark, str(tmp_path / "h.csv"))
    assert [r.station_id for r in C.select_stations(h).collect()] == ["725300-94846"]
    assert h.filter("usaf = '1'").first().lon is None


def test_hours_over_a_stream(spark, tmp_path):
    from nimbora.streaming.hourly import hourly_stream

    spark.createDataFrame([("s", "2020-01-01 00:10:00", 1.0), ("s", "2020-01-01 00:50:00", 3.0), ("s", "2020-01-01 09:00:00", 9.0)], "station_id string, t string, temp_c double").select("station_id", F.col("t").cast("timestamp").alias("obs_time"), "temp_c").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station_id string, obs_time timestamp, temp_c double").parquet(str(tmp_path / "in"))
    q = hourly_stream(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.temp_c, r.n_reports) for r in spark.table("hours").collect()] == [(2.0, 2)]


def test_shared_passes_equal_numpy(spark):
    """Every fit is a fixed point of Lloyd's step on what it sees; costs, spreads and outlines follow from it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 5)) + 4 * rng.integers(0, 3, (230, 1))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>").repartition(3)
    h = np.array([r.h for r in frame.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()], np.int64).view(np.uint64)
    fits = [V.Fit(3, 1), V.Fit(4, 2, dims=(0, 2, 3)), V.Fit(3, 3, share=0.8), V.Fit(3, 4, noise=0.1), V.Fit(300, 5)]
    bounds = V.limits(V.hashed(frame, "id", "v"), fits)
    for fit, bound, (centers, cost) in zip(fits, bounds, V.kmeans_fits(frame, "id", "v", fits), strict=True):
        y = V.view(fit, x, h, bound)
        d = ((y[:, None] - centers[None]) ** 2).sum(2)
        assert cost == pytest.approx(d.min(1).sum(), abs=1e-6)
        for k in np.unique(d.argmin(1)):
            assert np.allclose(centers[k], y[d.argmin(1) == k].mean(0), atol=1e-5)
    assert abs(len(V.view(fits[2], x, h, bounds[2])) - 184) <= 1
    moved = V.view(fits[3], x, h, bounds[3]) - x
    assert abs(moved.mean()) < 0.01 and abs(moved.std() - 0.1) < 0.01

    rows = {(r[0], r[1]): r for r in K.sweep(frame, "id", "v", 5, [2, 3], restarts=3, mixtures=2)}
    table = V.labelled(frame, "v", [V.by_centers(V.kmeans_fits(frame, "id", "v", [V.Fit(3, 42)])[0][0])]).withColumn("label", F.col("labels")[0]).drop("labels")
    assert rows["kmeans", 3][3] == pytest.approx(G.calinski_harabasz(table, "v", "label", 5).first().calinski_harabasz, rel=1e-9)
    assert rows["kmeans", 3][2] == pytest.approx(G.silhouette_samples(table, "id", "v", "label", 5).agg(F.avg("silhouette")).first()[0], rel=1e-9)
    assert K.choose_k(list(rows.values()), 2) == 3

    # Ward against the definition: each merge adds the least to the sum of squares.
    small = x[:25]
    groups = [[i] for i in range(25)]
    ss = lambda g: ((small[g] - small[g].mean(0)) ** 2).sum()
    while len(groups) > 4:
        _, a, b = min((ss(groups[a] + groups[b]) - ss(groups[a]) - ss(groups[b]), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] += groups[a]
        del groups[a]
    label = K.ward_labels(small, 4)
    assert sorted(sorted(g) for g in groups) == sorted(sorted(np.flatnonzero(label == k).tolist()) for k in range(4))

    scores, ratio, loadings = K.principal_components(frame, "id", "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:3]) and np.allclose(np.abs(loadings), np.abs(vt[:3].T))

    table = np.array([[10.0, 2, 0], [1, 20, 3], [0, 0, 9]])
    long = [(a, b) for a in range(3) for b in range(3) for _ in range(int(table[a, b]))]
    assert K.rand_of(table) == pytest.approx(G.adjusted_rand(spark.createDataFrame(long, "a int, b int"), "a", "b").first().ari)
    found = dict((k, (m, d)) for k, m, d in K.stability(frame, "id", "v", 5, 3, repeats=4))
    assert found["noise"][0] > 0.8 and found["subsample"][0] > 0.5
    gone = K.feature_ablation(frame, "id", "v", list("abcde"), 3)
    assert [g[0] for g in gone] == list("abcde") and all(0 < g[1] < 1 and g[2] > 0.5 for g in gone)


def test_ranks_and_distances_by_position(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, v in zip(rng.choice(["a", "b", None], 400), rng.integers(0, 40, 400), strict=True)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for r in grouped_ranks(frame, "g", "v").collect():
        own = [v for g, v in rows if g == r.g]
        assert (r.n, r.before, r.total) == (own.count(r.v), sum(v < r.v for v in own), len(own))


def test_top_loadings(spark):
    rows = [("pc1", "a", 0.2), ("pc1", "b", -0.9), ("pc1", "c", 0.2), ("pc2", "a", 1.0)]
    got = api.top_loadings(spark.createDataFrame(rows, "component string, feature string, loading double"), 2).collect()
    assert sorted((r.component, r["rank"], r.feature) for r in got) == [("pc1", 1, "b"), ("pc1", 2, "a"), ("pc2", 1, "a")]


def test_build_reads_what_it_wrote(spark, tmp_path):
    """Documents before and after, and the tables of the model's part, from features of known groups."""
    assert B.stats(spark, str(tmp_path)).collect() == [] and B.diagnostics(spark, str(tmp_path)).collect() == []
    rng = np.random.default_rng(4)
    rows = [(f"{i:06d}-00001", f"p{i}", "S%d" % (i % 3), 30.0 + i, -100.0 + i, 5.0, 1.0, *map(float, rng.normal(10 * (i % 3), 1, len(FEATURE_NAMES)))) for i in range(24)]
    frame = spark.createDataFrame(rows, "station_id string, name string, state string, lat double, lon double, elev_m double, valid_day_fraction double, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    R.write_table(frame, str(tmp_path / "features"))
    B.build_model(str(tmp_path), spark, Climate(neighbors=3), B.Model(ks=(2, 3), least_k=2, restarts=3, final_restarts=3, mixtures=1, repeats=2))
    places = B.table(spark, str(tmp_path), "locations")
    by = {}
    for r in places.collect():
        by.setdefault(r.cluster, set()).add(int(r.station_id[:6]) % 3)
    assert {k: len(v) for k, v in by.items()} == {0: 1, 1: 1, 2: 1}
    means = [r.m for r in places.groupBy("cluster").agg(F.avg("annual_mean_temp_f").alias("m")).orderBy("cluster").collect()]
    assert means == sorted(means)
    told = B.diagnostics(spark, str(tmp_path)).first()
    assert told.k == 3 and len(told.sweep) == 6 and len(told.geo_signal) == 29 and told.silhouette > 0.5
    assert {f.name: f.dataType.simpleString() for f in B.table(spark, str(tmp_path), "vectors").schema}["z"] == "array<float>"
    assert B.table(spark, str(tmp_path), "neighbors").count() == 72


def test_documents_of_many_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{\n "a": 1,\n "b": [2,\n 3]}\n')
    assert R.read_document(spark, str(tmp_path / "doc.json"), "a int, b array<int>", lines=False).first().b == [2, 3]
