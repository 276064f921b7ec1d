"""The same results in DuckDB's SQL, written on their own: common table expressions and one select each."""

from __future__ import annotations

# Fixed values, spelled out once more, so that a wrong one under test does not pass.
BOUNDS = {
    "temp_c": (-60.0, 60.0),
    "dewpoint_c": (-70.0, 40.0),
    "wind_speed_ms": (0.0, 75.0),
    "slp_hpa": (900.0, 1090.0),
    "visibility_m": (0.0, 160000.0),
    "ceiling_m": (0.0, 22000.0),
    "precip_mm": (0.0, 500.0),
    "snow_depth_cm": (0.0, 500.0),
    "sky_cover_oktas": (0.0, 8.0),
}
QC_OF = {
    "temp_c": "temp_qc",
    "dewpoint_c": "dewpoint_qc",
    "wind_dir": "wind_dir_qc",
    "wind_speed_ms": "wind_speed_qc",
    "slp_hpa": "slp_qc",
    "visibility_m": "visibility_qc",
    "ceiling_m": "ceiling_qc",
    "precip_mm": "precip_qc",
    "snow_depth_cm": "snow_depth_qc",
    "sky_cover_oktas": "sky_cover_qc",
}
CONTINUOUS = ["temp_c", "dewpoint_c", "wind_speed_ms", "slp_hpa", "visibility_m", "ceiling_m", "sky_cover_oktas"]
PRECIP_FEATURES = ["annual_precip_in", "wet_days_per_year", "summer_precip_fraction", "frozen_precip_days_per_year"]
#: Feature: label, unit.
FEATURES = {
    "annual_mean_temp_f": ("Annual mean temperature", "°F"),
    "winter_mean_temp_f": ("Winter (DJF) mean temperature", "°F"),
    "summer_mean_temp_f": ("Summer (JJA) mean temperature", "°F"),
    "seasonal_temp_range_f": ("Seasonal range (summer - winter)", "°F"),
    "diurnal_temp_range_f": ("Mean diurnal range (daily max - min)", "°F"),
    "hot_days_per_year": ("Days >= 90°F per year", "days/yr"),
    "freeze_days_per_year": ("Days with min <= 32°F per year", "days/yr"),
    "annual_precip_in": ("Annual precipitation", "in"),
    "wet_days_per_year": ("Wet days (>= 0.04 in) per year", "days/yr"),
    "summer_precip_fraction": ("Share of precipitation falling in JJA", "fraction"),
    "frozen_precip_days_per_year": ("Frozen-precipitation days per year (proxy for snow days)", "days/yr"),
    "summer_dewpoint_f": ("Summer (JJA) mean dew point", "°F"),
    "annual_dewpoint_depression_f": ("Mean dew-point depression (T - Td)", "°F"),
    "mean_wind_mph": ("Mean wind speed", "mph"),
}
PHRASES = {
    "summer_mean_temp_f": ("cool summers", "mild summers", "warm summers", "hot summers", "very hot summers"),
    "winter_mean_temp_f": ("long, frigid winters", "cold winters", "cool winters", "mild winters", "winters that barely register"),
    "summer_dewpoint_f": ("summer air is bone dry", "summer air is fairly dry", "summer humidity is moderate", "summers are humid", "summers are oppressively humid"),
    "annual_precip_in": ("it is one of the driest places in our table", "it is drier than most of the country", "it gets about average annual precipitation", "it is wetter than most of the country", "it is among the wettest places in our table"),
    "frozen_precip_days_per_year": ("frozen precipitation is essentially unknown", "frozen precipitation is rare", "there are some frozen-precipitation days each winter", "frozen precipitation is frequent in winter", "frozen precipitation is a regular part of winter"),
    "mean_wind_mph": ("winds are calm", "winds are light", "winds are moderate", "it is breezy", "it is persistently windy"),
    "diurnal_temp_range_f": ("almost no day-night temperature swing", "small day-night temperature swings", "typical day-night swings", "large day-night temperature swings", "huge day-night temperature swings"),
    "summer_precip_fraction": ("summers are the dry season", "most rain falls outside summer", "rain is spread through the year", "summer is the wettest season", "rain is heavily concentrated in summer"),
}
#: Guessed places: latitudes 25, 29, ... and longitudes -124, -116, ...
GUESSES = [(float(lat), float(lon)) for lat in range(25, 50, 4) for lon in range(-124, -66, 8)]
FEATURE_NAMES = list(FEATURES)

N = FEATURE_NAMES
DIMS = range(len(N))


def r(x: str, places: int = 5) -> str:
    return f"round(({x}) + 1.7e-8::DOUBLE, {places}) + 0.0"


def rn(names: list[str], places: int = 5, prefix: str = "") -> str:
    return ", ".join(f"{r(prefix + n, places)} AS {n}" for n in names)


ID = lambda a, b: f"lpad(({a})::VARCHAR, 6, '0') || '-' || lpad(({b})::VARCHAR, 5, '0')"
LAT = lambda k: f"24 + ({k} * 7919 % 26000) / 1000.0::DOUBLE"
LON = lambda k: f"-125 + ({k} * 104729 % 59000) / 1000.0::DOUBLE"
HAV = lambda a, b, c, d: f"2 * 3958.8::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"

STATIONS = f"""stations AS (SELECT {ID('s_suppkey', 's_nationkey')} AS station_id, s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 'CA' ELSE 'US' END AS country, n_name AS state,
  'K' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS icao, {LAT('s_suppkey')} AS lat, {LON('s_suppkey')} AS lon, s_acctbal / 10 AS elev_m, (2010 + s_suppkey % 8)::INT AS begin_year, (2020 + s_suppkey % 7)::INT AS end_year, s_suppkey AS k
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

OBS = f"""e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k, event_id AS i, user_id AS u FROM events),
obs AS (SELECT {ID('u', 'u % 25')} AS station_id, {LAT('u')} AS lat, {LON('u')} AS lon, ts AS obs_time, year(ts)::INT AS source_year,
  CASE event_type WHEN 'signup' THEN 'SOD  ' WHEN 'view' THEN 'FM-15' WHEN 'click' THEN 'FM-16' WHEN 'purchase' THEN 'CRN05' ELSE 'FM-12' END AS report_type,
  CASE WHEN k <> 99 THEN value - 20 END AS temp_c, (k % 10)::VARCHAR AS temp_qc, CASE WHEN k % 7 <> 0 THEN value - 30 END AS dewpoint_c, (k // 10 % 10)::VARCHAR AS dewpoint_qc,
  (i * 37 % 360)::DOUBLE AS wind_dir, (i % 10)::VARCHAR AS wind_dir_qc, CASE WHEN i % 11 <> 0 THEN (i % 800) / 10.0::DOUBLE END AS wind_speed_ms, (i // 10 % 10)::VARCHAR AS wind_speed_qc,
  890 + (i % 2100) / 10.0::DOUBLE AS slp_hpa, (i // 100 % 10)::VARCHAR AS slp_qc, (i * 7 % 170000)::DOUBLE AS visibility_m, (i // 3 % 10)::VARCHAR AS visibility_qc,
  (i * 3 % 23000)::DOUBLE AS ceiling_m, (i // 7 % 10)::VARCHAR AS ceiling_qc, CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 24.0::DOUBLE END AS precip_period_h,
  CASE WHEN k % 4 < 2 THEN (k % 40) / 10.0::DOUBLE END AS precip_mm, (i // 5 % 10)::VARCHAR AS precip_qc, CASE WHEN k % 3 = 0 THEN k * 6.0::DOUBLE END AS snow_depth_cm, (i // 13 % 10)::VARCHAR AS snow_depth_qc,
  (k % 10)::DOUBLE AS sky_cover_oktas, (i // 17 % 10)::VARCHAR AS sky_cover_qc FROM e)"""

KEPT_TYPE = "report_type IN ('FM-12', 'FM-13', 'FM-15', 'FM-16', 'CRN05', 'MESOW', 'SY-MT', 'SY-SA', 'SAO', 'SAOSP', 'AUTO', 'AERO')"
FLAG = {n: f"({n} IS NOT NULL AND {q} IN ('2', '3', '6', '7'))" for n, q in QC_OF.items()}
WIDE = {n: f"({n} IS NOT NULL AND NOT {n} BETWEEN {BOUNDS[n][0]} AND {BOUNDS[n][1]})" if n in BOUNDS else "false" for n in QC_OF}
CLEAN = OBS + f""",
cleaned AS (SELECT source_year, station_id, lat, lon, obs_time, precip_period_h, {', '.join(f'CASE WHEN NOT {FLAG[n]} AND NOT {WIDE[n]} THEN {n} END AS {n}' for n in QC_OF)} FROM obs WHERE {KEPT_TYPE})"""
HOURLY = CLEAN + f""",
hourly AS (SELECT source_year, station_id, lat, lon, date_trunc('hour', obs_time) AS hour, {', '.join(f'avg({n}) AS {n}' for n in CONTINUOUS)},
  avg(sin(radians(wind_dir))) FILTER (WHERE wind_speed_ms IS NOT NULL) AS wind_u, avg(cos(radians(wind_dir))) FILTER (WHERE wind_speed_ms IS NOT NULL) AS wind_v,
  max(precip_mm) FILTER (WHERE precip_period_h = 1) AS precip_1h_mm, max(precip_mm) FILTER (WHERE precip_period_h = 24) AS precip_24h_mm, max(snow_depth_cm) AS snow_depth_cm, count(*)::BIGINT AS n_reports
  FROM cleaned GROUP BY ALL)"""
DAY = "CAST(hour + to_hours(CAST(round_even(lon / 15.0::DOUBLE, 0) AS INT)) AS DATE)"
DAILY = HOURLY + f""",
d0 AS (SELECT source_year, station_id, {DAY} AS day, count(*)::BIGINT AS n_hours, count(temp_c)::BIGINT AS n_temp_hours, sum(n_reports)::BIGINT AS n_reports, avg(temp_c) AS tm, max(temp_c) AS tx, min(temp_c) AS tn,
  avg(dewpoint_c) AS dewpoint_mean_c, avg(wind_speed_ms) AS wind_mean_ms, max(wind_speed_ms) AS wind_max_ms, avg(wind_u) AS wind_u, avg(wind_v) AS wind_v, avg(slp_hpa) AS slp_mean_hpa, avg(visibility_m) AS visibility_mean_m,
  avg(sky_cover_oktas) AS sky_cover_mean_oktas, coalesce(sum(precip_1h_mm), 0) AS precip_1h_mm, count(precip_1h_mm)::BIGINT AS n_precip_1h_reports, max(precip_24h_mm) AS precip_24h_mm, max(snow_depth_cm) AS snow_depth_cm, min(ceiling_m) AS ceiling_min_m
  FROM hourly GROUP BY 1, 2, 3),
daily AS (SELECT * EXCLUDE (tm, tx, tn), CASE WHEN n_temp_hours >= 2 THEN tm END AS temp_mean_c, CASE WHEN n_temp_hours >= 2 THEN tx END AS temp_max_c, CASE WHEN n_temp_hours >= 2 THEN tn END AS temp_min_c,
  n_temp_hours >= 2 AS valid_day, CASE WHEN n_temp_hours >= 2 THEN precip_1h_mm END AS precip_mm FROM d0)"""

FEATS = STATIONS + f""",
g AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS hours, count(*) AS n_reports, avg(l_quantity) AS q, max(l_quantity) AS qx, min(l_quantity) AS qn, avg(l_discount) AS disc,
  avg((l_partkey % 12)::DOUBLE) AS wind, avg((l_partkey % 16000)::DOUBLE) AS vis, avg(990 + (l_partkey % 50)::DOUBLE) AS slp, avg((l_partkey % 9)::DOUBLE) FILTER (WHERE l_partkey % 3 = 0) AS sky,
  max((l_partkey % 40)::DOUBLE) FILTER (WHERE l_partkey % 5 = 0) AS snow, sum(l_tax * 20) AS rain, count(*) FILTER (WHERE l_tax > 0.02::DOUBLE) AS n1, max(l_tax) FILTER (WHERE l_partkey % 4 = 0) AS p24 FROM lineitem GROUP BY 1, 2),
days AS (SELECT {ID('l_suppkey', 's_nationkey')} AS station_id, day, hours >= 18 AS v, n_reports, CASE WHEN hours >= 18 THEN q - 20 END AS tm, CASE WHEN hours >= 18 THEN qx - 20 END AS tx, CASE WHEN hours >= 18 THEN qn - 20 END AS tn,
  disc * 200 - 5 AS dew, wind, vis, slp, sky, snow, CASE WHEN hours >= 18 THEN rain END AS rain, n1, p24, month(day) IN (12, 1, 2) AS winter, month(day) IN (6, 7, 8) AS summer FROM g JOIN supplier ON l_suppkey = s_suppkey),
f0 AS (SELECT station_id, count(*)::BIGINT AS n_days_with_data, (count(*) FILTER (WHERE v))::BIGINT AS n_valid_days, sum(n_reports)::BIGINT AS n_hourly_reports, min(day) AS first_day, max(day) AS last_day, count(DISTINCT year(day))::BIGINT AS n_years,
  count(tm)::BIGINT AS n_temp_days, (count(dew) FILTER (WHERE v))::BIGINT AS n_dewpoint_days, (count(wind) FILTER (WHERE v))::BIGINT AS n_wind_days, (count(vis) FILTER (WHERE v))::BIGINT AS n_visibility_days, (count(slp) FILTER (WHERE v))::BIGINT AS n_slp_days,
  (count(sky) FILTER (WHERE v))::BIGINT AS n_sky_days, (count(snow) FILTER (WHERE v))::BIGINT AS n_snow_depth_days, (count(p24) FILTER (WHERE v))::BIGINT AS n_precip_24h_days, (count(*) FILTER (WHERE v AND n1 > 0))::BIGINT AS n_days_with_precip_report,
  avg(tm) * 9 / 5 + 32 AS annual_mean_temp_f, avg(tm) FILTER (WHERE winter) * 9 / 5 + 32 AS winter_mean_temp_f, avg(tm) FILTER (WHERE summer) * 9 / 5 + 32 AS summer_mean_temp_f, avg(tx - tn) * 9 / 5 AS diurnal_temp_range_f,
  365.25::DOUBLE / nullif(count(*) FILTER (WHERE v), 0) AS y, count(*) FILTER (WHERE tx >= 32.2::DOUBLE) * y AS hot_days_per_year, count(*) FILTER (WHERE tn <= 0) * y AS freeze_days_per_year,
  coalesce(sum(rain), 0) * y / 25.4::DOUBLE AS a, count(*) FILTER (WHERE rain >= 1) * y AS b, coalesce(sum(rain) FILTER (WHERE summer), 0) / nullif(coalesce(sum(rain), 0), 0) AS c, count(*) FILTER (WHERE rain >= 1 AND tm <= 0) * y AS d,
  avg(dew) FILTER (WHERE v AND summer) * 9 / 5 + 32 AS summer_dewpoint_f, avg(tm - dew) FILTER (WHERE v) * 9 / 5 AS annual_dewpoint_depression_f, avg(wind) FILTER (WHERE v) * 2.23694::DOUBLE AS mean_wind_mph,
  avg(vis) FILTER (WHERE v) / 1609.344::DOUBLE AS mean_visibility_mi, avg(slp) FILTER (WHERE v) AS mean_slp_hpa, avg(sky) FILTER (WHERE v) AS mean_sky_cover_oktas, avg(snow) FILTER (WHERE v) AS mean_snow_depth_cm FROM days GROUP BY 1),
feats AS (SELECT * EXCLUDE (y, a, b, c, d), summer_mean_temp_f - winter_mean_temp_f AS seasonal_temp_range_f, n_days_with_precip_report >= 0.02::DOUBLE * n_valid_days AS has_precip_gauge, n_valid_days / 2556.75::DOUBLE AS valid_day_fraction,
  CASE WHEN has_precip_gauge THEN a END AS annual_precip_in, CASE WHEN has_precip_gauge THEN b END AS wet_days_per_year, CASE WHEN has_precip_gauge THEN c END AS summer_precip_fraction, CASE WHEN has_precip_gauge THEN d END AS frozen_precip_days_per_year FROM f0),
kept AS (SELECT f.*, s.name, s.state, s.icao, s.lat, s.lon, s.elev_m FROM feats f LEFT JOIN stations s USING (station_id) WHERE valid_day_fraction >= 0.14::DOUBLE AND {' AND '.join(f'isfinite({n})' for n in N)})"""
Z = FEATS + f""",
mom AS (SELECT {', '.join(f'avg({n}) AS m{i}, stddev_pop({n}) AS s{i}' for i, n in enumerate(N))} FROM kept),
z AS (SELECT station_id, {', '.join(f'({n} - m{i}) / (CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END) AS z{i}' for i, n in enumerate(N))} FROM kept, mom)"""


def dist(use=DIMS, a: str = "a", b: str = "b") -> str:
    return "sqrt(0.0" + "".join(f" + ({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in use) + ")"


PAIRS = Z + f", pairs AS (SELECT a.station_id AS a, b.station_id AS b, {dist()} AS d FROM z a JOIN z b ON a.station_id < b.station_id)"
RANKED = PAIRS + ", ranked AS (SELECT a, b, d, 100 * (1 - (rank() OVER (ORDER BY d) - 1) / (count(*) OVER ())::DOUBLE) AS s FROM pairs)"
EDGES = RANKED + f""", both_ AS (SELECT a, b, d, s FROM ranked UNION ALL SELECT b, a, d, s FROM ranked),
near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM both_ QUALIFY rank <= 10),
edges AS (SELECT n.a AS station_id, n.b AS neighbor_id, n.rank::INT AS rank, n.d AS climate_distance, n.s AS similarity_pct, {HAV('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS geo_distance_mi FROM near n JOIN kept x ON n.a = x.station_id JOIN kept y ON n.b = y.station_id)"""


def pct(source: str, n: str) -> str:
    return f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE) * 100 / (count(*) OVER ()) AS pct_{n}"


PROFILES = FEATS + f""", exact AS (SELECT station_id, name, state, icao, lat, lon, elev_m, n_hourly_reports, n_valid_days, first_day, {rn(N)} FROM kept),
prof AS (SELECT *, {', '.join(pct('exact', n) for n in N)} FROM exact)"""
GUESS = "guess AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(GUESSES)) + ") t(guess_id, lat, lon))"


def best(places: str) -> str:
    return f"best AS (SELECT g.guess_id, g.lat AS g_lat, g.lon AS g_lon, p.station_id, {HAV('g.lat', 'g.lon', 'p.lat', 'p.lon')} AS d FROM guess g, {places} p QUALIFY row_number() OVER (PARTITION BY g.guess_id ORDER BY d, p.station_id) = 1)"


def score(d: str) -> str:
    return f"(CASE WHEN {d} <= 15 THEN 5000 ELSE round_even(5000 * exp(-({d} - 15) / 1250.0::DOUBLE), 0) END)::INT"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def band(f: str) -> str:
    p = PHRASES[f]
    return f"(CASE WHEN pct_{f} < 15 THEN {quote(p[0])} WHEN pct_{f} < 35 THEN {quote(p[1])} WHEN pct_{f} < 65 THEN {quote(p[2])} WHEN pct_{f} < 85 THEN {quote(p[3])} ELSE {quote(p[4])} END)"


def cap(f: str) -> str:
    return f"(upper(substr({band(f)}, 1, 1)) || substr({band(f)}, 2))"


GROUPED = Z + ", grouped AS (SELECT k.*, z.* EXCLUDE (station_id), (substr(k.station_id, 8, 5)::INT % 4) AS cluster FROM kept k JOIN z USING (station_id))"
GSIL = f"""gm AS (SELECT a.station_id AS a, a.cluster AS la, b.cluster AS lb, avg({dist()}) AS mean FROM grouped a JOIN grouped b ON a.station_id <> b.station_id GROUP BY 1, 2, 3),
gw AS (SELECT g.station_id, max(mean) FILTER (WHERE lb = g.cluster) AS w, min(mean) FILTER (WHERE lb <> g.cluster) AS b FROM grouped g LEFT JOIN gm ON g.station_id = gm.a GROUP BY 1),
gsil AS (SELECT station_id, CASE WHEN w IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - w) / nullif(greatest(b, w), 0), 0) END AS silhouette FROM gw)"""
REPORT = EDGES + f""", exact AS (SELECT station_id, {rn(N)} FROM kept), prof AS (SELECT station_id, {', '.join(pct('exact', n) for n in N)} FROM exact), t AS (SELECT min(station_id) AS t FROM kept),
locs AS (SELECT k.*, p.* EXCLUDE (station_id), z.* EXCLUDE (station_id), (substr(k.station_id, 8, 5)::INT % 4) AS cluster FROM kept k JOIN prof p USING (station_id) JOIN z USING (station_id))"""
GAPS = REPORT + f""", {GUESS}, {best('kept')}, gap AS (""" + " UNION ALL ".join(f"SELECT guess_id, '{n}' AS feature, {quote(FEATURES[n][0])} AS label, {quote(FEATURES[n][1])} AS unit, a.{n} AS guess_value, b.{n} AS target_value, a.pct_{n} AS guess_percentile, b.pct_{n} AS target_percentile, abs(a.z{i} - b.z{i}) AS z_gap FROM best JOIN locs a USING (station_id) JOIN t ON true JOIN locs b ON b.station_id = t.t" for i, n in enumerate(N)) + ")"
VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
VPAIRS = VEC + ", x AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM vec), vp AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM vec a, vec b WHERE a.vec_id <> b.vec_id)"
SIL = VPAIRS + """, m AS (SELECT a, vec.label AS lb, avg(d) AS mean FROM vp JOIN vec ON b = vec_id GROUP BY 1, 2),
w AS (SELECT o.vec_id, o.label, max(mean) FILTER (WHERE lb = o.label) AS w, min(mean) FILTER (WHERE lb <> o.label) AS b FROM vec o LEFT JOIN m ON o.vec_id = m.a GROUP BY 1, 2),
sil AS (SELECT vec_id, label, CASE WHEN w IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - w) / nullif(greatest(b, w), 0), 0) END AS silhouette FROM w)"""
CENT = VEC + """, x AS (SELECT vec_id, label, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM vec), cent AS (SELECT label, j, avg(c) AS m FROM x GROUP BY 1, 2)"""


def geo(variants: dict[str, list[int]], places: int) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS variant, a.station_id AS a, b.station_id AS b, {dist(use)} AS d FROM z a JOIN z b ON a.station_id <> b.station_id" for n, use in variants.items())
    return f"""WITH {Z}, long AS ({rows}), nn AS (SELECT *, 1 / greatest(d, 1e-6::DOUBLE) AS w FROM long QUALIFY row_number() OVER (PARTITION BY variant, a ORDER BY d, b) <= 5),
gs AS (SELECT variant, a, sum(w * p.lat) / sum(w) AS glat, sum(w * p.lon) / sum(w) AS glon FROM nn JOIN kept p ON b = p.station_id GROUP BY 1, 2)
SELECT variant, {r('median(' + HAV('p.lat', 'p.lon', 'glat', 'glon') + ')', places)} AS median_error_mi FROM gs JOIN kept p ON a = p.station_id GROUP BY 1"""


def counter(kind: str) -> str:
    cond = {"qc": lambda n: FLAG[n], "range": lambda n: f"{WIDE[n]} AND NOT {FLAG[n]}", "clean": lambda n: f"{n} IS NOT NULL AND NOT {FLAG[n]} AND NOT {WIDE[n]}"}[kind]
    return f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{n}' AS variable, (count(*) FILTER (WHERE {KEPT_TYPE} AND {cond(n)}))::BIGINT AS n FROM obs" for n in QC_OF)


LINES = """e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k, event_id AS i, user_id AS u FROM events)"""
OVER = ["n_days_with_data", "n_valid_days", "n_hourly_reports", "n_years", "n_temp_days", "n_dewpoint_days", "n_wind_days", "n_visibility_days", "n_slp_days", "n_sky_days", "n_snow_depth_days", "n_precip_24h_days", "n_days_with_precip_report"]
EXTRA = ["mean_visibility_mi", "mean_slp_hpa", "mean_sky_cover_oktas", "mean_snow_depth_cm", "valid_day_fraction"]
HOUR_COLS = [*CONTINUOUS, "wind_u", "wind_v", "precip_1h_mm", "precip_24h_mm", "snow_depth_cm"]
DAY_COLS = ["temp_mean_c", "temp_max_c", "temp_min_c", "dewpoint_mean_c", "wind_mean_ms", "wind_max_ms", "wind_u", "wind_v", "slp_mean_hpa", "visibility_mean_m", "sky_cover_mean_oktas", "precip_1h_mm", "precip_24h_mm", "snow_depth_cm", "ceiling_min_m", "precip_mm"]


def oracle_sql() -> dict[str, str]:
    coverage = {v: f"n_{v}_days" for v in ("temp", "dewpoint", "wind", "visibility", "slp", "sky", "snow_depth", "precip_24h")} | {"precip_report": "n_days_with_precip_report"}
    every = list(DIMS)
    variants = {f"without {n}": [j for j in every if j != i] for i, n in enumerate(N)} | {f"only {n}": [i] for i, n in enumerate(N)}
    profile = f"SELECT station_id, name, state, {rn(['lat', 'lon', 'elev_m'])}, n_hourly_reports, n_valid_days, first_day::VARCHAR AS first_day, {', '.join(N)}, {rn(['pct_' + n for n in N])} FROM prof"
    traits = " UNION ALL ".join(f"SELECT cluster, '{n}' AS feature, {quote(FEATURES[n][0].lower())} AS label, round(avg(z{i}), 9) AS z FROM grouped GROUP BY 1" for i, n in enumerate(N))
    f_rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT cluster, count({n}) AS n, avg({n}) AS m, var_pop({n}) AS v FROM grouped GROUP BY 1))" for n in N)
    choose = lambda n: f"({n}) * (({n}) - 1) / 2.0::DOUBLE"
    found = {
        "station_select": f"WITH {STATIONS} SELECT station_id, name, state, {rn(['lat', 'lon'])}, begin_year, end_year FROM stations WHERE country = 'US' AND lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66 AND begin_year <= 2015 AND end_year >= 2024",
        "fixed_width_parse": f"""WITH {LINES} SELECT event_id, {ID('u', 'u % 25')} AS station_id, date_trunc('minute', ts)::VARCHAR AS obs_time, 41.995::DOUBLE AS lat, -87.934::DOUBLE AS lon, 'FM-15' AS report_type, {r('(i * 37 % 360)::DOUBLE')} AS wind_dir,
          {r('(i % 800) / 10.0::DOUBLE')} AS wind_speed_ms, {r('(i * 7 % 160000)::DOUBLE')} AS visibility_m, CASE WHEN k <> 99 THEN {r('(floor(value * 10) - 200) / 10.0::DOUBLE')} END AS temp_c, '1' AS temp_qc, 15.0::DOUBLE AS dewpoint_c, 1013.2::DOUBLE AS slp_hpa FROM e""",
        "regex_sections": f"""WITH {LINES} SELECT event_id, CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE END AS precip_period_h, CASE WHEN k % 4 = 0 THEN {r('(k % 40) / 10.0::DOUBLE')} END AS precip_mm, CASE WHEN k % 4 = 0 THEN '1' END AS precip_qc,
          CASE WHEN k % 4 = 1 THEN k::DOUBLE END AS snow_depth_cm, CASE WHEN k % 4 = 1 THEN '1' END AS snow_depth_qc, CASE WHEN k % 4 = 1 THEN (k % 9)::DOUBLE END AS sky_cover_oktas, CASE WHEN k % 4 = 1 THEN '1' END AS sky_cover_qc FROM e""",
        "report_type_counts": f"WITH {OBS} SELECT report_type, count(*)::BIGINT AS n FROM obs GROUP BY 1",
        "qc_null_counts": counter("qc"), "range_null_counts": counter("range"), "clean_value_counts": counter("clean"),
        "cleaning_accounting": f"WITH {HOURLY}, t AS (SELECT (SELECT count(*) FROM obs) AS n_raw, (SELECT count(*) FROM obs WHERE NOT {KEPT_TYPE}) AS n_dropped, (SELECT count(*) FROM hourly) AS n_clean, (SELECT sum(n_reports) FROM hourly) AS n) SELECT n_raw::BIGINT AS n_raw, n_dropped::BIGINT AS n_dropped, (n - n_clean)::BIGINT AS n_collapsed, n_clean::BIGINT AS n_clean, n_raw - n_dropped = n AS holds FROM t",
        "hour_collapse": f"WITH {HOURLY} SELECT source_year, station_id, {rn(['lat', 'lon'])}, hour::VARCHAR AS hour, {rn(HOUR_COLS)}, n_reports FROM hourly",
        "wind_vector_mean": f"WITH {HOURLY} SELECT source_year, station_id, hour::VARCHAR AS hour, {rn(['wind_u', 'wind_v'])} FROM hourly WHERE wind_u IS NOT NULL",
        "precip_period_max": f"WITH {HOURLY} SELECT source_year, station_id, hour::VARCHAR AS hour, {rn(['precip_1h_mm', 'precip_24h_mm'])} FROM hourly",
        "local_day": f"WITH {HOURLY} SELECT ({DAY})::VARCHAR AS day, count(*)::BIGINT AS n_hours, count(DISTINCT station_id)::BIGINT AS n_stations FROM hourly GROUP BY 1",
        "daily_aggregate": f"WITH {DAILY} SELECT source_year, station_id, day::VARCHAR AS day, n_hours, n_temp_hours, n_reports, n_precip_1h_reports, valid_day, {rn(DAY_COLS)} FROM daily",
        "valid_day_nulling": f"WITH {DAILY} SELECT valid_day, count(*)::BIGINT AS n_days, count(temp_mean_c)::BIGINT AS n_temp, count(precip_mm)::BIGINT AS n_precip, count(dewpoint_mean_c)::BIGINT AS n_dewpoint FROM daily GROUP BY 1",
        "station_features": f"WITH {FEATS} SELECT station_id, {', '.join(OVER)}, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, has_precip_gauge, {rn([*N, *EXTRA])} FROM feats",
        "precip_gauge_rule": f"WITH {FEATS} SELECT station_id, n_days_with_precip_report, n_valid_days, has_precip_gauge, {rn(PRECIP_FEATURES)} FROM feats",
        "coverage_pct": f"WITH {FEATS} " + " UNION ALL ".join(f"SELECT '{v}' AS variable, round(100.0::DOUBLE * sum({n}) / sum(n_valid_days), 2) AS pct FROM feats" for v, n in coverage.items()),
        "missing_feature_counts": f"WITH {FEATS} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, (count(*) FILTER (WHERE {n} IS NULL OR NOT isfinite({n})))::BIGINT AS n_missing FROM feats WHERE valid_day_fraction >= 0.14::DOUBLE" for n in N),
        "features_join_stations": f"WITH {FEATS} SELECT f.station_id, name, state, {rn(['lat', 'lon', 'elev_m'])}, n_valid_days, {rn(['annual_mean_temp_f'])} FROM feats f LEFT JOIN stations USING (station_id)",
        "keep_filter": f"WITH {FEATS} SELECT station_id, name, {rn(['valid_day_fraction'])} FROM kept",
        "zscore": f"WITH {Z} SELECT station_id, {', '.join(f'{r(f"z{i}")} AS {n}' for i, n in enumerate(N))} FROM z",
        "percentile_rank": f"WITH {FEATS}, p AS (SELECT station_id, {', '.join(pct('kept', n) for n in N)} FROM kept) SELECT station_id, {rn(['pct_' + n for n in N])} FROM p",
        "pairwise_quantiles": f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, {r(f'quantile_cont(d, {p})')} AS d FROM pairs" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9)),
        "knn10": f"WITH {VPAIRS} SELECT a AS vec_id, b AS neighbor_id, (row_number() OVER (PARTITION BY a ORDER BY d, b))::INT AS rank, {r('d')} AS distance FROM vp QUALIFY rank <= 10",
        "similarity_pct": f"WITH {RANKED} SELECT a, b, {r('d')} AS d, {r('s')} AS similarity_pct FROM ranked",
        "neighbor_edges": f"WITH {EDGES} SELECT station_id, neighbor_id, rank, {rn(['climate_distance', 'similarity_pct', 'geo_distance_mi'])} FROM edges",
        "haversine_pairs": f"WITH {STATIONS} SELECT s.station_id, t.station_id AS other_id, {r(HAV('s.lat', 's.lon', 't.lat', 't.lon'))} AS miles FROM stations s JOIN stations t ON s.k = t.k - 1",
        "nearest_station": f"WITH {STATIONS}, {GUESS}, {best('stations')} SELECT guess_id, station_id, {r('d')} AS distance_mi FROM best",
        "distance_score": f"WITH {STATIONS}, {GUESS}, {best('stations')} SELECT guess_id, {score('round(d, 6)')} AS score FROM best",
        "climate_clue": f"WITH {PROFILES} SELECT station_id, 'This place has ' || {band('summer_mean_temp_f')} || ' and ' || {band('winter_mean_temp_f')} || '; ' || {band('summer_dewpoint_f')} || '. ' || {cap('annual_precip_in')} || ', and ' || {band('summer_precip_fraction')} || '. ' || {cap('frozen_precip_days_per_year')} || '. ' || {cap('mean_wind_mph')} || ', with ' || {band('diurnal_temp_range_f')} || '.' AS clue FROM prof",
        "clue_facts": f"WITH {PROFILES} " + " UNION ALL ".join(f"SELECT station_id, '{f}' AS feature, {quote(FEATURES[f][0])} AS label, {f} AS value, {quote(FEATURES[f][1])} AS unit, {r(f'round(pct_{f}, 1)')} AS percentile, {band(f)} AS phrase FROM prof" for f in PHRASES),
        "clue_verify": r"""WITH d AS (SELECT doc_id, lower(lang) AS a, lower(source) AS b, (n_chars % 1000) / 10.0::DOUBLE AS x, text AS s FROM documents),
          p AS (SELECT doc_id, (length(a) >= 3 AND contains(lower(s), a))::INT + (length(b) >= 3 AND contains(lower(s), b))::INT AS named,
          len(list_filter(regexp_extract_all(s, '-?\d+(?:\.\d+)?'), lambda n: NOT (n::DOUBLE IN (round_even(x, 0), round_even(x, 1)) OR round_even(n::DOUBLE, 0) IN (round_even(x, 0), round_even(x, 1))))) AS wrong FROM d)
          SELECT doc_id, named + wrong = 0 AS ok, (named + wrong)::INT AS n_problems FROM p""",
        "extremes_high": f"WITH {FEATS} SELECT station_id, {rn(['annual_mean_temp_f'])} FROM (SELECT * FROM kept ORDER BY kept.annual_mean_temp_f DESC, station_id LIMIT 10)",
        "extremes_low": f"WITH {FEATS} SELECT station_id, {rn(['annual_precip_in'])} FROM (SELECT * FROM kept ORDER BY kept.annual_precip_in, station_id LIMIT 10)",
        "silhouette_samples": f"WITH {SIL} SELECT vec_id, label, {r('silhouette')} AS silhouette FROM sil",
        "outliers": f"WITH {SIL}, t AS (SELECT vec_id, label, round(silhouette, 6) AS x FROM sil ORDER BY x, vec_id LIMIT 15) SELECT vec_id, label, {r('x', 4)} AS silhouette FROM t",
        "climate_twins": f"WITH {EDGES}, t AS (SELECT * FROM edges WHERE geo_distance_mi >= 500 ORDER BY climate_distance, station_id, neighbor_id LIMIT 20) SELECT t.station_id AS a, t.neighbor_id AS b, x.name AS a_name, y.name AS b_name, {r('climate_distance')} AS climate_distance, {r('geo_distance_mi')} AS geo_distance_mi FROM t JOIN kept x ON t.station_id = x.station_id JOIN kept y ON t.neighbor_id = y.station_id",
        "pair_similarity": f"WITH {RANKED}, two AS (SELECT station_id, row_number() OVER (ORDER BY station_id) AS i FROM kept) SELECT p.a, p.b, {r('p.d')} AS climate_distance, {r('p.s')} AS similarity_pct, {r(HAV('x.lat', 'x.lon', 'y.lat', 'y.lon'))} AS geo_distance_mi FROM ranked p JOIN two u ON p.a = u.station_id AND u.i = 1 JOIN two v ON p.b = v.station_id AND v.i = 2 JOIN kept x ON p.a = x.station_id JOIN kept y ON p.b = y.station_id",
        "guess_report": f"WITH {Z}, {GUESS}, {best('kept')}, t AS (SELECT * FROM kept ORDER BY station_id LIMIT 1), m AS (SELECT b0.guess_id, t.station_id AS target, round({HAV('b0.g_lat', 'b0.g_lon', 't.lat', 't.lon')}, 6) AS mi, b0.station_id AS nearest, {dist(DIMS, 'a', 'b')} AS cd FROM best b0 CROSS JOIN t JOIN z a ON a.station_id = b0.station_id JOIN z b ON b.station_id = t.station_id) SELECT guess_id, target, {r('mi')} AS distance_mi, {score('mi')} AS score, nearest, {r('cd')} AS climate_distance FROM m",
        "location_profile": f"WITH {PROFILES} {profile}",
        "cluster_summary": f"WITH {GROUPED}, {GSIL} SELECT cluster, count(*)::BIGINT AS size, {r('avg(lat)')} AS lat, {r('avg(lon)')} AS lon, {', '.join(f'{r(f"avg({n})")} AS {n}' for n in N)}, {r(' + '.join(f'var_pop(z{i})' for i in DIMS))} AS within_variance, {', '.join(f'{r(f"avg(z{i})")} AS z_{n}' for i, n in enumerate(N))}, {r('avg(silhouette)')} AS silhouette FROM grouped JOIN gsil USING (station_id) GROUP BY 1",
        "cluster_states_top6": f"WITH {GROUPED}, t AS (SELECT cluster, state, count(*)::BIGINT AS n FROM grouped GROUP BY 1, 2) SELECT cluster, state, n, (row_number() OVER (PARTITION BY cluster ORDER BY n DESC, state))::INT AS rank FROM t QUALIFY rank <= 6",
        "cluster_traits_top4": f"WITH {GROUPED}, t AS ({traits}) SELECT cluster, (row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature))::INT AS rank, feature, (CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END) || label || ' (' || printf('%+.1f', z) || ' sd)' AS trait FROM t QUALIFY rank <= 4",
        "calinski_harabasz": f"WITH {CENT}, g AS (SELECT j, avg(c) AS m FROM x GROUP BY 1), s AS (SELECT label, count(*) AS n FROM vec GROUP BY 1), w AS (SELECT sum((x.c - c.m) * (x.c - c.m)) AS w FROM x JOIN cent c USING (label, j)), b AS (SELECT sum(s.n * (c.m - g.m) * (c.m - g.m)) AS b FROM cent c JOIN g USING (j) JOIN s USING (label)), k AS (SELECT count(*) AS k, sum(n) AS n FROM s) SELECT k::BIGINT AS k, {r('w')} AS inertia, {r('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM w, b, k",
        "adjusted_rand": f"WITH t AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT sum({choose('n')}) AS s, sum(n) AS n FROM t), ra AS (SELECT sum({choose('n')}) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY a)), cb AS (SELECT sum({choose('n')}) AS c FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT {r('(s - r * c / (' + choose('n') + ')) / ((r + c) / 2 - r * c / (' + choose('n') + '))', 9)} AS ari FROM s, ra, cb",
        "f_ratio": f"WITH {GROUPED}, t AS ({f_rows}) SELECT feature, {r('f')} AS f FROM t",
        "correlation_matrix": f"WITH {FEATS} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} AS r FROM kept" for i, a in enumerate(N) for b in N[i:]),
        "geo_signal_5nn": geo({"all": every}, 4),
        "geo_signal_ablation": geo(variants, 3),
        "centroid_separation": f"WITH {CENT}, p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM cent a JOIN cent b ON a.label < b.label AND a.j = b.j GROUP BY 1, 2) SELECT {r('min(d)')} AS min_separation, {r('avg(d)')} AS mean_separation FROM p",
        "latency_summary": "WITH t AS (SELECT '/api/' || event_type || '/{id}' AS endpoint, value AS ms FROM events), s AS (SELECT endpoint, ms, row_number() OVER (PARTITION BY endpoint ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM t) SELECT endpoint, n::BIGINT AS n, round(max(ms) FILTER (WHERE i = n // 2), 2) AS p50, round(max(ms) FILTER (WHERE i = least(n - 1, n * 95 // 100)), 2) AS p95, round(max(ms), 2) AS max FROM s GROUP BY endpoint, n",
        "ingest_summary": "WITH t AS (SELECT o_orderkey::VARCHAR AS f, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderstatus = 'O' THEN 'cached' ELSE 'downloaded' END AS status, floor(o_totalprice)::BIGINT AS b FROM orders) SELECT status, count(*)::BIGINT AS n_files, sum(b)::BIGINT AS bytes, (count(*) FILTER (WHERE status = 'missing'))::INT AS n_missing, coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE status = 'missing'), '') AS missing FROM t GROUP BY 1",
        "missing_files": "SELECT o_orderkey::VARCHAR AS file FROM orders WHERE o_orderkey % 97 = 0",
        "round_outcomes": "WITH e AS (SELECT user_id::BIGINT AS player, event_id::BIGINT AS i, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('view', 'click')), "
        "n AS (SELECT *, lead(event_type) OVER w AS kind, lead(i) OVER w AS j, lead(ms) OVER w AS later FROM e WINDOW w AS (PARTITION BY player ORDER BY ms, i)), "
        "o AS (SELECT *, coalesce(kind = 'click' AND later <= ms + 21600000, false) AS hit FROM n WHERE event_type = 'view' AND (j IS NOT NULL OR ms + 21600000 < (SELECT max(ms) FROM e))) "
        f"SELECT player, i AS round_id, CASE WHEN hit THEN j ELSE -1 END AS guess_id, hit AS answered, CASE WHEN hit THEN {r('(later - ms) / 1000.0::DOUBLE')} END AS seconds FROM o",
        "incremental_build": f"WITH {DAILY.replace('FROM events)', 'FROM (SELECT * REPLACE (ts - to_years((event_id % 3)::INT) AS ts) FROM events))')}, "
        f"h AS (SELECT source_year, count(*)::BIGINT AS n_hours, sum(n_reports)::BIGINT AS n_reports, {r('sum(temp_c)')} AS temp_c, count(DISTINCT station_id)::BIGINT AS n_stations FROM hourly GROUP BY 1), "
        f"y AS (SELECT source_year, count(*)::BIGINT AS n_days, count(*) FILTER (WHERE valid_day)::BIGINT AS n_valid, {r('sum(temp_mean_c)')} AS temp_mean_c FROM daily GROUP BY 1), "
        f"c AS (SELECT source_year, count(*)::BIGINT AS n_raw, count(*) FILTER (WHERE NOT {KEPT_TYPE})::BIGINT AS n_dropped, count(DISTINCT report_type)::BIGINT AS n_types, "
        + ", ".join(f"count(*) FILTER (WHERE {KEPT_TYPE} AND {cond})::BIGINT AS {k}_{n}" for n in ("temp_c", "visibility_m") for k, cond in (("raw", f"{n} IS NOT NULL"), ("qc", FLAG[n]), ("range", f"{WIDE[n]} AND NOT {FLAG[n]}"), ("clean", f"{n} IS NOT NULL AND NOT {FLAG[n]} AND NOT {WIDE[n]}")))
        + " FROM obs GROUP BY 1) SELECT * FROM h JOIN y USING (source_year) JOIN c USING (source_year)",
        "clipped_scale": f"WITH {FEATS}, x AS (SELECT station_id, {r('annual_mean_temp_f')} AS x FROM kept), s AS (SELECT list_sort(list(x)) AS s FROM x), q AS (SELECT s[1 + floor(0.02::DOUBLE * (len(s) - 1))::INT] AS lo, s[1 + floor(0.98::DOUBLE * (len(s) - 1))::INT] AS hi FROM s) SELECT station_id, {r('greatest(0, least(1, (x - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)))')} AS shade FROM x, q",
        "guess_answer": f"WITH {GAPS}, m AS (SELECT guess_id, b.station_id AS target, round({HAV('best.g_lat', 'best.g_lon', 'b.lat', 'b.lon')}, 6) AS mi, a.station_id AS nearest, a.cluster = b.cluster AS same_cluster, b.cluster AS cluster, {dist()} AS cd FROM best JOIN locs a USING (station_id) JOIN t ON true JOIN locs b ON b.station_id = t.t) SELECT guess_id, target, {r('mi')} AS distance_mi, {score('mi')} AS score, nearest, same_cluster, cluster, {r('cd')} AS climate_distance, {r('coalesce(s, 100)')} AS similarity_pct, {r('(SELECT max(z_gap) FROM gap WHERE gap.guess_id = m.guess_id)')} AS widest_gap, {len(PHRASES)}::INT AS n_facts, (SELECT count(*) FROM edges WHERE station_id = m.target)::INT AS n_neighbors FROM m LEFT JOIN ranked ON ranked.a = least(target, nearest) AND ranked.b = greatest(target, nearest)",
        "guess_gaps": f"WITH {GAPS} SELECT guess_id, feature, label, unit, {rn(['guess_value', 'target_value', 'guess_percentile', 'target_percentile', 'z_gap'])} FROM gap",
        "feature_gaps": f"WITH {Z}, two AS (SELECT *, row_number() OVER (ORDER BY station_id) AS i FROM z) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, {r(f'abs(a.z{i} - b.z{i})')} AS z_gap FROM two a JOIN two b ON a.i = 1 AND b.i = 2" for i, n in enumerate(N)),
        "location_answer": f"WITH {REPORT} SELECT station_id, name, state, {rn(['lat', 'lon', 'elev_m'])}, cluster, {rn(N)}, {rn(['pct_' + n for n in N])}, {', '.join(f'{r(f"z{i}")} AS z_{n}' for i, n in enumerate(N))}, n_valid_days, n_years, first_day::VARCHAR AS first_day, (SELECT count(*) FROM edges e WHERE e.station_id = locs.station_id)::INT AS n_neighbors FROM locs JOIN t ON station_id = t.t",
        "location_neighbors": f"WITH {REPORT} SELECT e.station_id, rank, neighbor_id, k.name, k.state, {rn(['lat', 'lon'], prefix='k.')}, k.cluster, {rn(['climate_distance', 'similarity_pct', 'geo_distance_mi'])} FROM edges e JOIN t ON e.station_id = t.t JOIN locs k ON k.station_id = e.neighbor_id",
        "describe_features": f"WITH {FEATS}, exact AS (SELECT {rn(N)} FROM kept) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n})::BIGINT AS count, (count(*) - count({n}))::BIGINT AS nulls, {r(f'avg({n})')} AS mean, {r(f'stddev_samp({n})')} AS std, {r(f'min({n})')} AS min, " + ", ".join(f"{r(f'list_sort(list({n}))[1 + round_even({p}::DOUBLE * (count({n}) - 1), 0)::INT]')} AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75)) + f", {r(f'max({n})')} AS max FROM exact" for n in N),
        "counter_totals": f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, (" + " + ".join(f"count(*) FILTER (WHERE {KEPT_TYPE} AND {cond(n)})" for n in QC_OF) + ")::BIGINT AS total FROM obs" for k, cond in (("raw", lambda n: f"{n} IS NOT NULL"), ("qc", lambda n: FLAG[n]), ("range", lambda n: f"{WIDE[n]} AND NOT {FLAG[n]}"), ("clean", lambda n: f"{n} IS NOT NULL AND NOT {FLAG[n]} AND NOT {WIDE[n]}"))),
        "percent_left": f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{n}' AS variable, round(100.0::DOUBLE * (count(*) FILTER (WHERE {KEPT_TYPE} AND {n} IS NOT NULL AND NOT {FLAG[n]} AND NOT {WIDE[n]})) / (count(*) FILTER (WHERE {KEPT_TYPE})), 1) AS pct FROM obs" for n in QC_OF),
        "vectors_float32": f"WITH {Z} SELECT station_id, {', '.join(f'{r(f"z{i}::FLOAT::DOUBLE", 4)} AS {n}' for i, n in enumerate(N))} FROM z",
        "history_csv": f"WITH {STATIONS} SELECT station_id, substr(station_id, 1, 6) AS usaf, substr(station_id, 8, 5) AS wban, name, country, state, icao, {rn(['lat', 'lon'])}, CASE WHEN k % 3 <> 0 THEN {r('elev_m')} END AS elev_m, begin_year, end_year FROM stations",
        "gzip_lines": f"WITH {LINES} SELECT year(ts)::INT AS source_year, {ID('u', 'u % 25')} AS station_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE k <> 99)::BIGINT AS n_temp, {r('sum((i * 37 % 360)::DOUBLE)')} AS wind_dir, min(date_trunc('minute', ts))::VARCHAR AS first_time FROM e WHERE i % 10 <> 0 GROUP BY 1, 2",
        "multi_line_json": "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation",
        "station_search": f"WITH {STATIONS} SELECT station_id, name, state FROM stations WHERE contains(lower(name || ' ' || state || ' ' || station_id), 'on_1') ORDER BY station_id LIMIT 12",
        "health": f"WITH {GROUPED} SELECT count(*)::BIGINT AS locations, count(DISTINCT cluster)::BIGINT AS clusters FROM grouped",
    }
    return found | {"build_tables": build_tables(found)}


#: Rules of the build's model that hold whatever its random starts are.
RULES = [
    "clusters by mean temperature", "k of the best silhouette", "sweep tries all", "summaries of clusters", "loadings have length 1", "variance falls", "stability between -1 and 1",
    "ablation of each feature", "f ratios of each feature", "document repeats the sweep", "document repeats the signal",
]


def build_tables(found: dict[str, str]) -> str:
    """(part, name, value) of everything that the build writes and SQL can work out."""

    def sums(part: str, source: str, names: list[str]) -> list[str]:
        return [f"SELECT '{part}' AS part, 'rows' AS name, count(*)::DOUBLE AS value FROM {source}"] + [f"SELECT '{part}', '{n}', sum({r(n)})::DOUBLE FROM {source}" for n in names]

    sub = lambda name: f"({found[name]})"
    parts = sums("hourly", "hourly", ["n_reports", "temp_c", "wind_u"]) + sums("daily", "daily", ["n_hours", "temp_mean_c", "precip_mm"])
    parts += ["SELECT 'features', 'rows', count(DISTINCT station_id)::DOUBLE FROM daily", "SELECT 'vectors', 'rows', count(*)::DOUBLE FROM kept"]
    parts += sums("locations", "kept", N) + [f"SELECT 'locations', 'pct_{n}', sum(pct_{n})::DOUBLE FROM ranks" for n in N] + sums("neighbors", "near", ["rank", "climate_distance", "similarity_pct", "geo_distance_mi"])
    parts += [f"SELECT 'quantiles', printf('%.2f', p), d FROM {sub('pairwise_quantiles')}", f"SELECT 'correlation', x || '|' || y, r FROM {sub('correlation_matrix')}"]
    parts += [f"SELECT 'geo_signal', variant, round(median_error_mi, 3) FROM {sub(q)}" for q in ("geo_signal_5nn", "geo_signal_ablation")]
    parts += [f"SELECT 'stats', '{n}', {n}::DOUBLE FROM {sub('cleaning_accounting')}" for n in ("n_raw", "n_dropped", "n_collapsed", "n_clean")] + ["SELECT 'stats', 'n_stations', count(DISTINCT station_id)::DOUBLE FROM daily"]
    parts += [f"SELECT '{field}', variable, n::DOUBLE FROM {sub(q)}" for field, q in (("qc_nulled", "qc_null_counts"), ("range_nulled", "range_null_counts"), ("clean_values", "clean_value_counts"))]
    parts += [f"SELECT 'rule', '{x}', 1.0::DOUBLE" for x in RULES]
    every = " UNION ALL ".join(parts)
    return f"WITH {DAILY}, {FEATS}, ranks AS {sub('percentile_rank')}, near AS {sub('neighbor_edges')} SELECT part, name, {r('value', 4)} AS value FROM ({every})"
