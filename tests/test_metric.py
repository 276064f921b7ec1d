"""Neighbours, ranks of distances and nearest places against brute force, with the work they do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.functions.geo import haversine_mi
from nimbora.operators import distance_ranks as R
from nimbora.operators import metric as M
from nimbora.operators import sphere as S

SMALL = M.Metric(piece=30, home=3, cell=60, pack=5)


def frame(spark, x, ids=None):
    kind = "string" if ids and isinstance(ids[0], str) else "long"
    return spark.createDataFrame([(ids[i] if ids else i, v.tolist()) for i, v in enumerate(x)], f"id {kind}, v array<double>")


def clouds(rng, n, dims, centers=15):
    """Groups of points on a coarse lattice, so that distances tie."""
    return np.round(rng.normal(0, 2, (centers, dims))[rng.integers(0, centers, n)] + rng.normal(0, 0.3, (n, dims)), 2)


def all_distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def neighbours(x, k, ids=None):
    d = all_distances(x)
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    rank = np.argsort(np.argsort(ids)) if ids else np.arange(len(x))
    who = ids or list(range(len(x)))
    out = set()
    for i in range(len(x)):
        best = np.lexsort((rank, d[i]))[: min(k, len(x) - 1)]
        out |= {(who[i], who[j], r + 1, d[i, j]) for r, j in enumerate(best.tolist())}
    return out


def told(rows):
    return {(r["a"], r["b"], r["rank"], r["d"]) for r in rows}


@pytest.mark.parametrize("dims,k", [(1, 3), (2, 5), (6, 4), (20, 7)])
def test_neighbours(spark, dims, k):
    x = clouds(np.random.default_rng(dims), 500, dims)
    rows = M.knn(frame(spark, x), "id", "v", dims, k, c=SMALL, stats=True).collect()
    assert len(rows) == 500 * k and told(rows) == neighbours(x, k)
    assert sum(r["looked"] for r in rows) < 0.5 * 500**2


def test_neighbours_of_copies(spark):
    """A third of the points is one point, and another group is just one larger than k + 1; ids are texts of different lengths."""
    x = clouds(np.random.default_rng(5), 300, 3)
    x[50:150], x[200:207] = x[0], x[1]
    ids = [f"s{'x' * (i % 4)}{i * 7919 % 1000}" for i in range(300)]
    assert told(M.knn(frame(spark, x, ids), "id", "v", 3, 5, c=SMALL).collect()) == neighbours(x, 5, ids)
    same = np.zeros((60, 2))
    assert told(M.knn(frame(spark, same), "id", "v", 2, 4, c=SMALL).collect()) == neighbours(same, 4)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_neighbours_of_few_points(spark, n):
    x = np.arange(2.0 * n).reshape(n, 2)
    got = M.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v", 2, 10)
    assert told(got.collect()) == neighbours(x, 10)


def test_variants_are_spaces_of_their_own(spark):
    x = clouds(np.random.default_rng(8), 200, 4)
    use = {"all": [0, 1, 2, 3], "one": [2], "two": [0, 3]}
    rows = M.knn(frame(spark, x), "id", "v", 4, 3, use, c=SMALL).collect()
    for name, dims in use.items():
        assert told([r for r in rows if r["variant"] == name]) == neighbours(x[:, dims], 3)


def test_work_grows_slower_than_pairs(spark):
    """Distances worked out for four times the points: far from sixteen times as many."""
    rng = np.random.default_rng(9)
    looked = []
    for n in (2_000, 8_000):
        x = rng.uniform(0, 1, (n, 3))
        rows = M.knn(frame(spark, x), "id", "v", 3, 5, c=M.Metric(piece=64, home=4, cell=200), stats=True).agg(F.sum("looked")).first()
        looked.append(rows[0])
    assert looked[1] < 0.15 * 8_000**2 and looked[1] < 8 * looked[0]


def test_pieces_hold_every_point_and_bounds_hold(spark):
    x = clouds(np.random.default_rng(10), 400, 5)
    p = M.pieces(frame(spark, x).select(F.lit("s").alias("space"), "id", "v"), 3, SMALL)
    rows = p.table.collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(400)) and max(r["n"] for r in rows) <= 30
    assert len({r["piece"] for r in rows}) == len(rows) and all(sum(q["home"] == r["home"] for q in rows) <= 3 for r in rows)
    for a in rows:
        for b in rows:
            d = all_distances(x)[np.ix_(a["ids"], b["ids"])]
            side = lambda r: (np.array([r["low"]]), np.array([r["high"]]))
            assert M.least(side(a), side(b))[0, 0] <= d.min() and d.max() <= M.greatest(side(a), side(b))[0, 0]


@pytest.mark.parametrize("dims", [1, 3, 12])
def test_distances_at_positions(spark, dims):
    x = clouds(np.random.default_rng(dims), 250, dims)
    d = np.sort(all_distances(x)[np.triu_indices(250, 1)])
    at = [0, 1, 1000, len(d) // 2, len(d) - 2, len(d) - 1]
    p = R._pieces(frame(spark, x), "id", "v", SMALL)
    got, work = R.distance_at(p, at)
    assert got == [d[i] for i in at]
    assert all(w["opened"] < w["pairs"] * w["ranges"] for w in work[1:])
    share = [0.0, 0.1, 0.5, 0.99, 1.0]
    assert [r["d"] for r in R.quantiles(frame(spark, x), "id", "v", share, SMALL).collect()] == pytest.approx(np.quantile(d, share).tolist(), rel=1e-12)


def test_quantiles_of_few_points(spark):
    assert R.quantiles(frame(spark, np.zeros((1, 2))), "id", "v", [0.5]).collect() == []
    assert [r["d"] for r in R.quantiles(frame(spark, np.zeros((3, 2))), "id", "v", [0.5]).collect()] == [0.0]
    assert [r["d"] for r in R.quantiles(frame(spark, np.array([[0.0], [3.0]])), "id", "v", [0.0, 1.0]).collect()] == [3.0, 3.0]


@pytest.mark.parametrize("size", [1 << 17, 40])
def test_shares_of_nearer_pairs(spark, size):
    """Limits in one block and in many, some of them distances that occur, some beyond all."""
    x = clouds(np.random.default_rng(3), 250, 4)
    d = np.sort(all_distances(x)[np.triu_indices(250, 1)])
    limits = sorted({*d[::300].tolist(), 0.0, 1e-300, float(d[-1]) + 1, 1e300})
    got = R.shares(frame(spark, x), "id", "v", spark.createDataFrame([(v,) for v in [*limits, *limits, None]], "far double"), "far", SMALL, size).collect()
    assert sorted(r["d"] for r in got) == limits
    assert {r["d"]: r["below"] for r in got} == {v: int(np.searchsorted(d, v)) for v in limits} and {r["total"] for r in got} == {len(d)}
    edges = M.knn(frame(spark, x), "id", "v", 4, 2, c=SMALL)
    rows = R.similarity_of(edges, frame(spark, x), "id", "v", c=SMALL, size=size).collect()
    assert len(rows) == 500 and all(r["similarity_pct"] == 100 * (1 - int(np.searchsorted(d, r["d"])) / len(d)) for r in rows)


def places(rng, n, kind):
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    if kind == "corners":  # poles, the date line from both sides, longitudes past 180
        lat = np.clip(rng.choice([89.9, -89.99, 0, 45], n) + rng.normal(0, 0.2, n), -90, 90)
        lon = rng.choice([179.9, -179.9, 0, 270, -100], n) + rng.normal(0, 0.3, n)
    return [(f"s{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]


@pytest.mark.parametrize("n,leaf,kind", [(200, 64, "even"), (1500, 6, "even"), (1500, 4, "corners")])
def test_nearest_places(spark, n, leaf, kind):
    rng = np.random.default_rng(n + leaf)
    rows = places(rng, n, kind)
    rows += [("a0", *rows[3][1:]), ("north", 90.0, 10.0), ("south", -90.0, 180.0), ("nowhere", None, 3.0)]
    spots = [(i, a, b) for i, (_, a, b) in enumerate(places(rng, 100, "even") + places(rng, 100, "corners") + [("", *rows[3][1:]), ("", 90.0, 0.0), ("", -90.0, 0.0), ("", 0.0, 180.0), ("", 0.0, -180.0)])]
    stations, guesses = spark.createDataFrame(rows, "station_id string, lat double, lon double"), spark.createDataFrame([*spots, (9999, None, 1.0)], "guess_id int, lat double, lon double")
    got = {r["guess_id"]: (r["station_id"], r["distance_mi"], r["cells"]) for r in S.nearest_places(guesses, stations, leaf, stats=True).collect()}
    met = guesses.filter("lat is not null").select("guess_id", F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(stations.filter("lat is not null"))
    want = met.groupBy("guess_id").agg(F.min(F.struct(haversine_mi("x", "y", "lat", "lon").alias("d"), "station_id")).alias("m")).collect()
    assert {k: v[:2] for k, v in got.items()} == {r["guess_id"]: (r["m"]["station_id"], r["m"]["d"]) for r in want}
    assert got[200][0] == "a0" and np.mean([v[2] for v in got.values()]) < 6


def test_nearest_of_one_and_of_copies(spark):
    guesses = spark.createDataFrame([(1, 10.0, 10.0), (2, -80.0, 200.0)], "guess_id int, lat double, lon double")
    one = spark.createDataFrame([("b", 1.0, 1.0)] * 3 + [("a", 1.0, 1.0)] * 200, "station_id string, lat double, lon double")
    assert {(r["guess_id"], r["station_id"]) for r in S.nearest_places(guesses, one, 4).collect()} == {(1, "a"), (2, "a")}
    assert S.nearest_places(guesses, one.limit(0)).collect() == []


def test_boxes_are_no_further_than_their_places(spark):
    """Boxes of three places each, and one of them."""
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in np.concatenate([rng.uniform(-90, 90, (600, 4)), rng.uniform(-180, 180, (600, 4))], 1)]
    f = spark.createDataFrame(rows, ", ".join(f"{n}{i} double" for n in ("lat", "lon") for i in range(4)))
    sides = [S.direction(F.col(f"lat{i}"), F.col(f"lon{i}")) for i in range(3)]
    box = F.struct(*[g(*[s[k] for s in sides]).alias(a + e) for k, a in enumerate(S.AXES) for e, g in (("1", F.least), ("2", F.greatest))])
    far = f.select(S.miles_to_box(S.direction(F.col("lat3"), F.col("lon3")), box).alias("lb"), haversine_mi("lat3", "lon3", "lat0", "lon0").alias("d"))
    assert far.filter("lb > d").count() == 0 and far.filter("lb > 0").count() > 100


@pytest.mark.parametrize("level", [3, 6, 30])
def test_cells_and_their_parents(spark, level):
    rng = np.random.default_rng(level)
    rows = [(float(a), float(b)) for a, b in rng.uniform([-90, -180], [90, 180], (300, 2))] + [(90.0, 179.999999), (-90.0, -180.0), (0.0, 45.0), (0.0, 180.0)]
    f = spark.createDataFrame(rows, "lat double, lon double").select(*S.direction(F.col("lat"), F.col("lon")))
    at = lambda n: S.cell(F.col("x"), F.col("y"), F.col("z"), n)
    assert f.filter(S.parent(at(level), level) != at(level - 3)).count() == 0
    assert f.select(at(level).alias("c")).filter((F.col("c") < 0) | (F.col("c") >= F.lit(6 << (2 * level)).cast("decimal(20,0)"))).count() == 0


def test_gaps_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for limits in (np.sort(rng.normal(5, 1, 500)), np.sort(np.concatenate([rng.uniform(0, 1e-6, 300), [3.0, 900.0]])), np.array([2.0]), np.array([0.0, 5e-324, 1e-320])):
        values = np.abs(np.concatenate([limits, np.nextafter(limits, 0), np.nextafter(limits, np.inf), rng.uniform(0, 10, 1_000), [0.0]]))
        values = values[values < limits[-1]]
        assert (R.Gaps(limits)(values) == np.searchsorted(limits, values, "right")).all()


def test_quantiles_open_a_pair_once_a_round(spark):
    x = clouds(np.random.default_rng(4), 300, 6)
    p = R._pieces(frame(spark, x), "id", "v", SMALL)
    _, work = R.distance_at(p, [100, 5_000, 20_000, 40_000])
    assert all(w["opened"] <= w["pairs"] for w in work) and len(work) <= 4
