"""The build year by year against the build at once; layouts that spare exchanges and scans."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.config import FEATURE_NAMES, Climate
from nimbora.operators import clean as C
from nimbora.operators.daily import daily_aggregate
from nimbora.operators.features import station_features
from nimbora.plans import analogs as A
from nimbora.plans import api
from nimbora.plans import yearly as Y
from nimbora.sources import records as R

DATA = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect())))


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    """Three years, the second first with half of its reports, the third twice."""
    root = f"file://{tmp_path_factory.mktemp('yearly')}"
    every = A.observations(spark, DATA, 3)
    first, second, third = (r[0] for r in every.select("source_year").distinct().orderBy("source_year").collect())
    of = lambda *ys: every.filter(F.col("source_year").isin(*ys))
    assert Y.add_years(of(first, second).filter((F.col("source_year") == first) | (F.col("event_id") % 5 < 2)), root, A.EVENTS, 3) == [first, second]
    Y.add_years(of(third), root, A.EVENTS, 3)
    assert Y.add_years(of(second, third), root, A.EVENTS, 7) == [second, third]  # the first layout stays
    return root, every


def test_years_added_equal_a_build_at_once(spark, taken):
    root, every = taken
    hours = C.hour_collapse(C.clean(every, A.EVENTS))
    assert rows(Y.table(spark, root, "hourly").select(*hours.columns)) == rows(hours)
    days = daily_aggregate(hours, A.EVENTS)
    assert rows(Y.table(spark, root, "daily").select(*days.columns)) == rows(days)
    whole = C.accounting(every, A.EVENTS)
    assert rows(Y.account(spark, root).select(*whole.columns)) == rows(whole)
    assert rows(Y.report_type_counts(spark, root)) == rows(C.report_type_counts(every))


def test_another_session_finds_the_tables(spark, taken):
    root, _ = taken
    for name in ("hourly", "daily", "counters"):
        spark.sql(f"DROP TABLE {Y._name(root, name)}")
    assert Y.table(spark, root, "daily").count() == spark.read.parquet(f"{root}/daily").count() > 0


def test_days_and_features_need_no_exchange(spark, taken):
    root, every = taken
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    hours = C.hour_collapse(C.clean(every.repartition(3, "station_id"), A.EVENTS))
    assert plan(hours).count("Exchange") == 1
    for frame in (daily_aggregate(Y.table(spark, root, "hourly"), A.EVENTS), station_features(Y.table(spark, root, "daily"), A.EVENTS)):
        assert "Exchange" not in plan(frame) and "Bucketed: true" in plan(frame)
    one = Y.table(spark, root, "hourly").filter(F.col("source_year") == 2023)
    assert "PartitionFilters: [isnotnull(source_year" in plan(one)


def test_a_year_without_kept_reports_goes(spark, tmp_path):
    root = f"file://{tmp_path}"
    every = A.observations(spark, DATA, 2)
    Y.add_years(every, root, A.EVENTS, 2)
    last = every.agg(F.max("source_year")).first()[0]
    Y.add_years(every.filter(F.col("source_year") == last).withColumn("report_type", F.lit("SOD  ")), root, A.EVENTS, 2)
    assert [r[0] for r in Y.table(spark, root, "hourly").select("source_year").distinct().collect()] == [last - 1]
    assert Y.account(spark, root).first()["n_dropped"] > 0
    with pytest.raises(ValueError):
        Y.add_years(every, root, Climate(merge_year_boundary=True))


def scanned(frame):
    """(result, rows that its scans put out)."""
    found = frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return found, sum(m.apply("numOutputRows").value() for m in metrics if m.contains("numOutputRows"))


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 20_000
    cells = [(f"{i * 7919 % 999983:06d}-{i:05d}", *map(float, rng.normal(size=40))) for i in range(n)]
    frame = spark.createDataFrame(cells, "station_id string, " + ", ".join(f"x{i} double" for i in range(40)))
    R.write_clustered(frame, str(tmp_path / "t"), "station_id", group_kb=256)
    had = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for i in (0, 777, n - 1):
            found, read = scanned(spark.read.parquet(str(tmp_path / "t")).filter(F.col("station_id") == cells[i][0]))
            assert [tuple(r) for r in found] == [cells[i]] and 0 < read < n / 10
        found, read = scanned(spark.read.parquet(str(tmp_path / "t")).filter(F.col("station_id") == "000000-none"))
        assert not found and read < n / 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", had)


def test_stored_tables_follow_their_input(spark, tmp_path):
    for name in ("lineitem", "supplier", "nation"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = A.features(spark, str(tmp_path))
    n = first.count()
    assert A.features(spark, str(tmp_path)) is first
    spark.read.parquet(f"{DATA}/lineitem.parquet").filter("l_suppkey % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "half"))
    (part,) = (tmp_path / "half").glob("part-*.parquet")
    (tmp_path / "lineitem.parquet").write_bytes(part.read_bytes())
    (tmp_path / ".lineitem.parquet.crc").unlink(missing_ok=True)
    assert 0 < A.features(spark, str(tmp_path)).count() < n


def test_ingest_leaves_files_and_their_counts(spark, tmp_path):
    status = spark.createDataFrame([("a", "downloaded", 5), ("b", "missing", None), ("c", "missing", None), ("d", "cached", 7)], "file string, status string, bytes long")
    R.write_ingest(status, str(tmp_path))
    assert {r.status: (r.n_files, r.bytes) for r in R.read_document(spark, f"{tmp_path}/summary", "status string, n_files long, bytes long").collect()} == {"downloaded": (1, 5), "missing": (2, 0), "cached": (1, 7)}
    assert {r.file for r in R.missing_files(spark.read.parquet(f"{tmp_path}/files")).collect()} == {"b", "c"}


def test_ingest_summary_lists_all_missing_files_in_order(spark, tmp_path):
    names = [f"f{i * 7919 % 1000:03}" for i in range(1000)]
    rows = [(n, "missing" if i % 3 else "cached", i) for i, n in enumerate(names)] + [("f005", "missing", 1)]
    R.write_ingest(spark.createDataFrame(rows, "file string, status string, bytes long"), str(tmp_path))
    got = {r.status: r for r in R.read_document(spark, f"{tmp_path}/summary", "status string, n_files long, bytes long, n_missing int, missing array<string>").collect()}
    want = sorted(n for n, s, _ in rows if s == "missing")
    assert (got["missing"].n_files, got["missing"].n_missing, got["missing"].missing) == (len(want), len(want), want)
    assert (got["cached"].n_files, got["cached"].n_missing, got["cached"].missing) == (334, 0, [])
    none = R.ingest_summary(spark.createDataFrame([("a", "cached", 1)], "file string, status string, bytes long")).first()
    assert (none.n_missing, none.missing) == (0, [])


def test_location_answer_asks_for_single_keys(spark, tmp_path):
    features = [x for i, n in enumerate(FEATURE_NAMES) for x in (f"{i}.5D as {n}", f"{i}.0D as pct_{n}")]
    cover = [f"1 as {c}" for c in api.COVERAGE]
    places = spark.range(500).selectExpr("lpad(cast(id as string), 6, '0') as station_id", "'n' as name", "'s' as state", "1.0D as lat", "2.0D as lon", "3.0D as elev_m", "0 as cluster", *features, *cover, f"array_repeat(0.0D, {len(FEATURE_NAMES)}) as z")
    edges = places.select("station_id", F.lpad((F.col("station_id").cast("int") + 1).cast("string"), 6, "0").alias("neighbor_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("climate_distance"), F.lit(50.0).alias("similarity_pct"), F.lit(9.0).alias("geo_distance_mi"))
    for name, frame in (("locations", places), ("neighbors", edges)):
        R.write_clustered(frame, str(tmp_path / name), "station_id")
    one = api.location_answer(spark.read.parquet(str(tmp_path / "locations")), spark.read.parquet(str(tmp_path / "neighbors")), "000042").collect()
    assert [(r.station_id, [(n.neighbor_id, n.name) for n in r.neighbors]) for r in one] == [("000042", [("000043", "n")])]
    assert api.location_answer(places, edges, "nowhere").collect() == []
