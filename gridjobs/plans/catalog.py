"""Registered queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions import grid, months, text, values
from gridjobs.functions.tables import few
from gridjobs.operators import cities, landcover, metrics, observed, quality, reshape, species, summed, trends, verify
from gridjobs.plans.fixtures import Fixtures, duckdb

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = ""):
    """Register a query on fixtures; `doubles` are rounded to 6 decimals on both sides."""
    names = doubles.split()

    def add(build):
        name = build.__name__

        def run(spark, sf_dir: str) -> DataFrame:
            out = build(Fixtures(spark, sf_dir))
            return out.withColumns({c: F.round(c, 6) + 0.0 for c in names}) if names else out

        _queries[name] = run
        if sql:
            replaced = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + CAST(0 AS DOUBLE) AS {c}' for c in names)}) FROM ({sql}) AS _r" if names else sql
            _sql[name] = duckdb(replaced)
        return build

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


BOX = {"min_lat": 40.0, "max_lat": 41.0, "min_lon": -4.0, "max_lon": -2.5}
SNAPPED = "SELECT species, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(round_even(latitude * 4, 0) AS INT) AS lat_i, CAST(round_even(longitude * 4, 0) AS INT) AS lon_i FROM {occ}"
DAYS = "CAST(day(last_day(month)) AS DOUBLE)"

METRICS = """count(*) AS cell_count, count(*) FILTER (v) AS valid_cell_count, avg(p) FILTER (v) AS predicted_mean, avg(o) FILTER (v) AS observed_mean, avg(abs(p - o)) FILTER (v) AS mae,
  sqrt(avg((p - o) * (p - o)) FILTER (v)) AS rmse, avg(p - o) FILTER (v) AS bias,
  CASE WHEN max(p) FILTER (v) > min(p) FILTER (v) AND max(o) FILTER (v) > min(o) FILTER (v) THEN covar_pop(p, o) FILTER (v) / nullif(stddev_pop(p) FILTER (v) * stddev_pop(o) FILTER (v), 0) END AS correlation,
  min(p) FILTER (v) AS predicted_min, max(p) FILTER (v) AS predicted_max, min(o) FILTER (v) AS observed_min, max(o) FILTER (v) AS observed_max,
  CASE WHEN abs(sum(abs(o)) FILTER (v)) > 1e-12 THEN 100 * sum(abs(p - o)) FILTER (v) / sum(abs(o)) FILTER (v) END AS wape_pct,
  avg(CASE WHEN abs(p) + abs(o) > 1e-12 THEN 200 * abs(p - o) / (abs(p) + abs(o)) ELSE 0 END) FILTER (v) AS smape_pct,
  CASE WHEN abs(avg(o) FILTER (v)) > 1e-12 THEN 100 * avg(abs(p - o)) FILTER (v) / abs(avg(o) FILTER (v)) END AS rmae_pct,
  CASE WHEN abs(avg(o) FILTER (v)) > 1e-12 THEN 100 * sqrt(avg((p - o) * (p - o)) FILTER (v)) / abs(avg(o) FILTER (v)) END AS cvrmse_pct"""
METRIC_COLUMNS = "predicted_mean observed_mean mae rmse bias correlation predicted_min predicted_max observed_min observed_max wape_pct smape_pct rmae_pct cvrmse_pct"
PAIRED = "SELECT *, predicted AS p, observed AS o, coalesce(predicted IS NOT NULL AND observed IS NOT NULL AND (variable <> 'NDVI' OR abs(observed) > 1e-12), false) AS v FROM {pairs}"
KEYS = ["forecast_month", "grp", "variable"]
METRIC_ROWS = f"SELECT forecast_month, grp, variable, {METRICS} FROM ({PAIRED}) GROUP BY ALL"
BINARY = """CAST(count(*) FILTER (p AND o) AS BIGINT) AS tp, count(*) FILTER (p AND NOT o) AS fp, count(*) FILTER (NOT p AND o) AS fn, count(*) FILTER (NOT p AND NOT o) AS tn"""
SCORES = """tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1_score, tp::DOUBLE / nullif(tp + fp + fn, 0) AS jaccard_similarity,
  2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS sorensen_similarity, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, tn::DOUBLE / nullif(tn + fp, 0) AS specificity"""
SCORE_COLUMNS = "precision recall f1_score jaccard_similarity sorensen_similarity accuracy specificity"


def metric_rows(f):
    return metrics.continuous_metrics(f.pairs, KEYS)


# projections, filters, predicates


@query("SELECT species, latitude AS raw_latitude, CAST(round_even(latitude * 4, 0) AS INT) AS lat_i, CAST(round_even(longitude * 4, 0) AS INT) AS lon_i, CAST(round_even(latitude * 4, 0) AS INT) * CAST(0.25 AS DOUBLE) AS latitude, CAST(round_even(longitude * 4, 0) AS INT) * CAST(0.25 AS DOUBLE) AS longitude FROM {occ}")
def snap_to_grid(f):
    return grid.snap_to_grid(f.occ.withColumn("raw_latitude", F.col("latitude"))).select("species", "raw_latitude", "lat_i", "lon_i", "latitude", "longitude")


@query("SELECT c_custkey, ((CAST(c_custkey % 360 AS DOUBLE) + 180) % 360) - 180 AS longitude FROM customer")
def normalize_longitude(f):
    return f.customer.select("c_custkey", grid.normalize_longitude((F.col("c_custkey") % 360).cast("double")).alias("longitude"))


@query("SELECT c_custkey, 30 + CAST(c_custkey % 200 AS DOUBLE) / 4 AS latitude, -30 + CAST(c_custkey % 320 AS DOUBLE) / 4 AS longitude FROM customer WHERE 30 + CAST(c_custkey % 200 AS DOUBLE) / 4 > 32 AND 30 + CAST(c_custkey % 200 AS DOUBLE) / 4 <= 72 AND -30 + CAST(c_custkey % 320 AS DOUBLE) / 4 >= -25 AND -30 + CAST(c_custkey % 320 AS DOUBLE) / 4 < 45")
def crop_domain(f):
    c = F.col("c_custkey")
    return grid.crop_domain(f.customer.select("c_custkey", (30.0 + (c % 200).cast("double") / 4).alias("latitude"), (-30.0 + (c % 320).cast("double") / 4).alias("longitude")))


@query("SELECT c_custkey, coalesce(lat BETWEEN 41 AND 44 AND lon BETWEEN 2 AND 9, false) AS inside_selected_area FROM (SELECT c_custkey, 40 + CAST(c_custkey % 40 AS DOUBLE) / 4 AS lat, CAST(c_custkey % 60 AS DOUBLE) / 4 AS lon FROM customer)")
def flag_inside(f):
    c = F.col("c_custkey")
    at = f.customer.select("c_custkey", (40.0 + (c % 40).cast("double") / 4).alias("latitude"), ((c % 60).cast("double") / 4).alias("longitude"))
    return grid.flag_inside(at, {"min_lat": 41.0, "max_lat": 44.0, "min_lon": 2.0, "max_lon": 9.0}).select("c_custkey", "inside_selected_area")


@query("""WITH g AS (SELECT DISTINCT latitude, longitude FROM {grid_obs}), near AS (SELECT area_label, latitude, longitude, latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon AS ok FROM g JOIN {areas} ON latitude BETWEEN min_lat - 0.125 AND max_lat + 0.125 AND longitude BETWEEN min_lon - 0.125 AND max_lon + 0.125)
SELECT area_label, latitude, longitude FROM near WHERE ok OR area_label NOT IN (SELECT area_label FROM near WHERE ok)""".replace("WITH g", "SELECT * FROM (WITH g") + ")")
def bbox_select_padded(f):
    cells = f.grid_obs.select("latitude", "longitude").distinct()
    return grid.select_bbox(cells, f.areas).select("area_label", "latitude", "longitude")


@query("SELECT value, lat - 0.5 AS min_lat, lat + 0.5 AS max_lat, lon - 0.5 AS min_lon, lon + 0.5 AS max_lon, (lat - 0.5 + lat + 0.5) / 2 AS center_lat, (lon - 0.5 + lon + 0.5) / 2 AS center_lon FROM {cities}")
def bbox_from_point(f):
    boxes = f.cities.select("value", *(c.alias(n) for n, c in grid.bbox_from_point("lat", "lon", 0.5).items()))
    return grid.bounds_center(boxes)


@query("SELECT month, count(*) AS n FROM {grid_obs} WHERE month IN (SELECT DISTINCT month FROM {grid_obs} WHERE month BETWEEN DATE '1996-03-01' AND DATE '1999-12-01' ORDER BY 1 LIMIT 20) GROUP BY 1")
def filter_months(f):
    return months.filter_months(f.grid_obs, "1996-03-01", "1999-12-01", 20).groupBy("month").agg(F.count("*").alias("n"))


LAND = "SELECT lat_i, lon_i FROM (SELECT lat_i, lon_i, arg_min(lsm, month) AS m FROM {grid_obs} GROUP BY 1, 2) WHERE m > 0.5"


@query(LAND)
def land_mask(f):
    return observed.land_mask(f.grid_obs)


@query("SELECT month, lat_i, lon_i, variable, CASE WHEN variable IN ('t2m', 'stl1') THEN value - 273.15 WHEN variable = 'tp' THEN value * 1000 ELSE value END AS value, CASE WHEN variable IN ('t2m', 'stl1') THEN '°C' WHEN variable = 'tp' THEN 'mm/month' ELSE 'native' END AS unit FROM {grid_long}", "value")
def display_units(f):
    return f.grid_long.select("month", "lat_i", "lon_i", "variable", values.display_value("variable", "value").alias("value"), values.display_unit("variable").alias("unit"))


@query(f"SELECT month, lat_i, lon_i, avg_tprate * 86400 AS precipitation_mean_daily_mm, avg_tprate * 86400 * {DAYS} AS precipitation_mean_mm, tp * 1000 / {DAYS} AS daily_from_tp FROM {{grid_obs}}", "precipitation_mean_daily_mm precipitation_mean_mm daily_from_tp")
def precipitation_mm(f):
    keys = ["month", "lat_i", "lon_i"]
    other = observed.precipitation_mm(f.grid_obs.select(*keys, "tp")).select(*keys, F.col("precipitation_mean_daily_mm").alias("daily_from_tp"))
    return observed.precipitation_mm(f.grid_obs).select(*keys, "precipitation_mean_daily_mm", "precipitation_mean_mm").join(other, keys)


GREEN = "least(greatest(1 - exp(-0.5 * (coalesce(lai_hv, 0) + coalesce(lai_lv, 0))), 0), 0.92)"


@query(f"SELECT month, lat_i, lon_i, CASE WHEN (lat_i, lon_i) IN (SELECT (lat_i, lon_i) FROM ({LAND})) THEN {GREEN} END AS ndvi_mean FROM {{grid_obs}}", "ndvi_mean")
def ndvi_from_lai(f):
    land = observed.land_mask(f.grid_obs).withColumn("land", F.lit(True))
    rows = f.grid_obs.join(land, ["lat_i", "lon_i"], "left")
    return rows.select("month", "lat_i", "lon_i", observed.ndvi_from_lai(land="land").alias("ndvi_mean"))


@query("SELECT DISTINCT lat_i, lon_i, printf('%.2f_%.2f', latitude, longitude) AS cell_id, cos(radians(latitude)) AS latitude_weight FROM {grid_obs}", "latitude_weight")
def cell_keys(f):
    return grid.cell_keys(f.grid_obs.select("lat_i", "lon_i", "latitude", "longitude").distinct()).select("lat_i", "lon_i", "cell_id", "latitude_weight")


@query("SELECT forecast_month, grp, variable, 4 - lat_index AS lat_index, 4 - lon_index AS lon_index, predicted FROM {pairs}", "predicted")
def flip_prediction(f):
    return grid.flip(f.pairs, True, True, 5, 5).select("forecast_month", "grp", "variable", "lat_index", "lon_index", "predicted")


LAYERS = "SELECT month, lat_i, lon_i, CASE variable WHEN 't2m' THEN 'temperature' ELSE variable END AS variable, CASE WHEN variable = 'swvl1' THEN 'predicted_swvl1_native' ELSE concat('predicted_', variable) END AS column_name, value FROM {grid_long}"


def layers(f):
    v = F.col("variable")
    return f.grid_long.select("month", "lat_i", "lon_i", F.when(v == "t2m", "temperature").otherwise(v).alias("variable"), F.when(v == "swvl1", "predicted_swvl1_native").otherwise(F.concat(F.lit("predicted_"), v)).alias("column_name"), "value")


GUARDED = f"SELECT month, lat_i, lon_i, variable, CASE WHEN variable IN ('temperature', 'stl1') AND (column_name LIKE '%\\_native' ESCAPE '\\' OR quantile_cont(abs(value), 0.5) OVER (PARTITION BY month, variable) > 150) THEN value - 273.15 ELSE value END AS value FROM ({LAYERS})"


@query(GUARDED, "value")
def kelvin_guard(f):
    return quality.kelvin_guard(layers(f)).select("month", "lat_i", "lon_i", "variable", "value")


@query("SELECT case_id, CASE WHEN abs(precipitation_observed_mm) < 1e-12 THEN CASE WHEN abs(precipitation_predicted_mm) < 1e-12 THEN 0 ELSE 100 END ELSE abs(precipitation_predicted_mm - precipitation_observed_mm) / abs(precipitation_observed_mm) * 100 END AS pct, abs(temperature_predicted_c - temperature_observed_c) / abs(temperature_observed_c + 273.15) * 100 AS pct_kelvin FROM {cases}", "pct pct_kelvin")
def pct_error(f):
    return f.cases.select("case_id", values.pct_error("precipitation_predicted_mm", "precipitation_observed_mm").alias("pct"), values.pct_error_kelvin("temperature_predicted_c", "temperature_observed_c").alias("pct_kelvin"))


@query("SELECT month, lat_i, lon_i, variable, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS scaled, value AS restored FROM {grid_long} WINDOW w AS (PARTITION BY variable)", "scaled restored")
def scale_roundtrip(f):
    rows = f.grid_long.select("month", "lat_i", "lon_i", "variable", F.lit(None).cast("int").alias("level"), "value")
    stats = rows.groupBy("variable", "level").agg(F.min("value").alias("stat_min"), F.max("value").alias("stat_max"), F.avg("value").alias("stat_mean"), F.stddev_pop("value").alias("stat_std"))
    scaled = quality.scale(rows, stats)
    back = quality.scale(scaled.withColumn("scaled", F.col("value")), stats, inverse=True)
    return back.select("month", "lat_i", "lon_i", "variable", "scaled", F.col("value").alias("restored"))


@query("SELECT month, lat_i, lon_i, variable, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS scaled FROM {grid_long} WINDOW w AS (PARTITION BY variable)", "scaled")
def scale_zscore(f):
    rows = f.grid_long.select("month", "lat_i", "lon_i", "variable", F.lit(None).cast("int").alias("level"), "value")
    stats = rows.groupBy("variable", "level").agg(F.min("value").alias("stat_min"), F.max("value").alias("stat_max"), F.avg("value").alias("stat_mean"), F.stddev_pop("value").alias("stat_std"))
    return quality.scale(rows, stats, "zscore").select("month", "lat_i", "lon_i", "variable", F.col("value").alias("scaled"))


@query(f"SELECT tile_seq, code, CASE WHEN code IN {landcover.ARABLE_CODES} THEN CAST(100 AS DOUBLE) ELSE 0 END AS arable, CASE WHEN code IN {landcover.CROPLAND_CODES} THEN CAST(100 AS DOUBLE) ELSE 0 END AS cropland, CASE WHEN value BETWEEN 0 AND 100 AND value <> nodata THEN value END AS forest, count(*) AS n FROM {{pixels}} GROUP BY ALL")
def landcover_mask(f):
    rows = f.pixels.select("tile_seq", "code", landcover.class_mask("code", landcover.ARABLE_CODES).alias("arable"), landcover.class_mask("code", landcover.CROPLAND_CODES).alias("cropland"), landcover.valid_range("value", "nodata").alias("forest"))
    return rows.groupBy("tile_seq", "code", "arable", "cropland", "forest").agg(F.count("*").alias("n"))


@query("SELECT month, lat_i, lon_i FROM {grid_obs} WHERE coalesce(t2m, swvl2, lai_hv) IS NOT NULL")
def drop_all_missing(f):
    return observed.drop_all_missing(f.grid_obs, ("t2m", "swvl2", "lai_hv")).select("month", "lat_i", "lon_i")


@query("SELECT area, month, forest - (arable + cropland) AS composite FROM {area_series}", "composite")
def landcover_composite(f):
    return f.area_series.select("area", "month", landcover.composite().alias("composite"))


@query("SELECT month, variable, lat_i, lon_i, CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS scaled FROM {grid_long} WINDOW w AS (PARTITION BY month, variable)", "scaled")
def color_scale(f):
    return trends.color_scale(f.grid_long, "value", ["month", "variable"]).select("month", "variable", "lat_i", "lon_i", "scaled")


@query(f"SELECT * FROM (SELECT forecast_month, grp, variable, mae FROM ({METRIC_ROWS})) WHERE (grp, lower(variable)) IN (('climate', 't2m'), ('climate', 'tp'), ('climate', 'd2m'), ('vegetation', 'ndvi'), ('forest', 'forest'), ('agriculture', 'agriculture'))", "mae")
def core_filter(f):
    return metric_rows(f).select("forecast_month", "grp", "variable", "mae").where(verify.core_filter())


@query(f"SELECT forecast_month, grp, variable, mae, CASE WHEN grp IN ('species', 'species_proxy') THEN 'species' WHEN grp IN ('misc', 'redlist', 'forest', 'agriculture') THEN 'context' WHEN grp IN ('edaphic', 'land') THEN 'soil_and_land' WHEN grp = 'climate' AND variable NOT IN ('t2m', 'tp') THEN 'climate_other' END AS sheet FROM ({METRIC_ROWS}) WHERE (grp, variable) IN ({', '.join(repr(x) for x in verify.CURATED)})", "mae")
def curated_filter(f):
    return verify.curated_filter(metric_rows(f)).select("forecast_month", "grp", "variable", "mae", verify.sheet_of().alias("sheet"))


@query("SELECT DISTINCT grp, variable FROM {pairs} WHERE (grp, variable) IN (SELECT (grp, variable) FROM {grid_long})".replace("(grp, variable) IN (SELECT (grp, variable)", "concat(grp, variable) IN (SELECT concat(grp, variable)"))
def shared_variables(f):
    return verify.shared_variables(f.pairs, f.grid_long)


@query(f"SELECT r.run_id, c.grp, c.variable FROM (SELECT DISTINCT run_id FROM {{pairs}}) r CROSS JOIN (VALUES {', '.join(repr(x) for x in verify.CURATED)}) c(grp, variable) WHERE NOT EXISTS (SELECT 1 FROM {{pairs}} p WHERE p.run_id = r.run_id AND p.grp = c.grp AND p.variable = c.variable)")
def missing_features(f):
    return verify.missing_features(f.pairs, verify.CURATED)


# joins and layers

SPECIES_CELL = f"SELECT month, lat_i, lon_i, count(DISTINCT species) AS species_count FROM ({SNAPPED}) GROUP BY ALL"


@query(f"SELECT * FROM ({SPECIES_CELL.replace('GROUP BY ALL', 'WHERE lat_i BETWEEN 160 AND 164 AND lon_i BETWEEN -16 AND -10 GROUP BY ALL')})")
def species_cell_month(f):
    return observed.species_cell_month(f.occ, BOX)


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT species) AS species_count_observed_area FROM {occ} WHERE latitude BETWEEN 40 AND 41 AND longitude BETWEEN -4 AND -2.5 GROUP BY 1")
def species_area_month(f):
    return observed.species_area_month(f.occ, BOX)


@query("SELECT area_label, CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT species) AS species_count_observed_area FROM {occ} JOIN (SELECT area_label, min_lat, max_lat, min_lon - 3 AS min_lon, max_lon - 3 AS max_lon FROM {areas}) a ON latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon GROUP BY 1, 2")
def species_areas(f):
    return species.species_areas(f.occ, f.areas.withColumns({c: F.col(c) - 3 for c in ("min_lon", "max_lon")}))


@query()
def sketched_species_areas(f):
    areas = f.areas.withColumns({c: F.col(c) - 3 for c in ("min_lon", "max_lon")})
    return species.sketched_areas(species.species_sketches(f.occ), areas, 12).drop("sketch")


@query()
def approx_species(f):
    return observed.species_cell_month(f.occ, BOX, approximate=True)


@query(f"SELECT m.month, s.species, c.lat_i, c.lon_i, CAST(CASE WHEN o.species IS NULL THEN 0 ELSE 1 END AS INT) AS presence FROM (SELECT DISTINCT lat_i, lon_i - 17 AS lon_i FROM {{grid_base}}) c CROSS JOIN {{months}} m CROSS JOIN (SELECT DISTINCT species FROM {{occ}}) s LEFT JOIN (SELECT DISTINCT * FROM ({SNAPPED})) o ON o.month = m.month AND o.species = s.species AND o.lat_i = c.lat_i AND o.lon_i = c.lon_i")
def species_presence(f):
    cells = f.grid_base.select("lat_i", (F.col("lon_i") - 17).alias("lon_i")).distinct()
    return observed.species_presence(f.occ, cells, f.occ, f.months).select("month", "species", "lat_i", "lon_i", "presence")


@query("SELECT coalesce(p.month, q.month) AS month, coalesce(p.lat_i, q.lat_i) AS lat_i, coalesce(p.lon_i, q.lon_i) AS lon_i, coalesce(CASE WHEN (p.k1) % 2 = 0 THEN p.ndvi END, CASE WHEN (q.k1) % 3 = 0 THEN q.swvl1 END) AS ndvi FROM (SELECT *, lat_i + lon_i AS k1 FROM {grid_obs}) p FULL JOIN (SELECT *, lat_i + lon_i AS k1 FROM {grid_obs}) q ON p.month = q.month AND p.lat_i = q.lat_i AND p.lon_i = q.lon_i", "ndvi")
def primary_fallback(f):
    at = F.col("lat_i") + F.col("lon_i")
    return observed.primary_fallback(f.grid_obs.withColumn("ndvi", F.when(at % 2 == 0, F.col("ndvi"))), f.grid_obs.withColumn("ndvi", F.when(at % 3 == 0, F.col("swvl1"))), "ndvi")


@query("SELECT month, lat_i, lon_i, avg(ndvi) AS ndvi_mean FROM {grid_obs} WHERE ndvi IS NOT NULL GROUP BY ALL", "ndvi_mean")
def monthly_layer(f):
    return observed.monthly_layer(f.grid_obs, "ndvi", "ndvi_mean")


@query("SELECT s.lat_i, s.lon_i, s.lsm, m.month FROM (SELECT DISTINCT lat_i, lon_i, lsm FROM {grid_obs}) s CROSS JOIN {months} m")
def static_broadcast(f):
    return observed.static_broadcast(f.grid_obs.select("lat_i", "lon_i", "lsm").distinct(), f.months)


ASOF = "SELECT m.month, l.lat_i, l.lon_i, l.value, l.year AS source_year FROM (SELECT month, max(y.year) AS year FROM (SELECT DISTINCT month FROM {months}) m JOIN (SELECT DISTINCT year FROM {land_long} WHERE variable = 'VAR') y ON y.year <= year(m.month) GROUP BY 1) m JOIN (SELECT year, lat_i, lon_i, avg(value) AS value FROM {land_long} WHERE variable = 'VAR' AND value IS NOT NULL GROUP BY ALL) l ON l.year = m.year"


@query(ASOF.replace("VAR", "Cropland"), "value")
def annual_layer_asof(f):
    return observed.yearly_asof(f.land_long, f.months, "Cropland")


@query("SELECT t.target, arg_min(s.source, struct_pack(d := abs(s.source - t.target), n := -s.source)) AS source FROM (SELECT DISTINCT CAST(lat_i AS DOUBLE) / 4 AS target FROM {grid_obs}) t CROSS JOIN (SELECT DISTINCT lat AS source FROM {cities}) s GROUP BY 1")
def nearest_to_grid(f):
    axis = f.grid_obs.select((F.col("lat_i").cast("double") / 4).alias("x"))
    return grid.nearest_to_grid(f.cities.select(F.col("lat").alias("x")), axis, "x")


@query("SELECT k.variable, k.year, g.lat_i, g.lon_i, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT lat_i, lon_i FROM {grid_obs}) g CROSS JOIN (SELECT DISTINCT variable, year FROM {land_long}) k LEFT JOIN (SELECT variable, year, lat_i, lon_i, avg(value) AS value FROM {land_long} WHERE value IS NOT NULL GROUP BY ALL) v USING (variable, year, lat_i, lon_i)", "value")
def to_model_grid(f):
    return grid.to_model_grid(f.land_long, f.grid_obs.select("lat_i", "lon_i").distinct(), "value", keys=("variable", "year"))


IN_AREA = "latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon"


@query(f"SELECT area_label, count(*) AS n FROM {{pairs}} JOIN {{areas}} ON {IN_AREA} GROUP BY 1")
def areas_range_join(f):
    return grid.areas_range_join(f.pairs, f.areas).groupBy("area_label").agg(F.count("*").alias("n"))


@query("SELECT p.forecast_month, p.variable, p.lat_index, p.lon_index, p.predicted, o.observed FROM (SELECT forecast_month, variable, 4 - lat_index AS lat_index, lon_index, predicted FROM {pairs}) p JOIN {pairs} o ON p.forecast_month = o.forecast_month AND p.variable = o.variable AND p.lat_index = o.lat_index AND p.lon_index = o.lon_index", "predicted observed")
def pair_maps(f):
    return verify.pair_maps(f.pairs, f.pairs, ["forecast_month", "variable"], flip_lat=True, size=(5, 5))


# metrics


@query(METRIC_ROWS, METRIC_COLUMNS)
def continuous_metrics(f):
    return metric_rows(f)


@query(f"""SELECT forecast_month, grp, variable, lat_index, lon_index, v AS metric_valid, CASE WHEN v AND abs(o) > 1e-12 THEN 100 * abs(p - o) / abs(o) END AS ape_pct, CASE WHEN v THEN CASE WHEN abs(p) + abs(o) > 1e-12 THEN 200 * abs(p - o) / (abs(p) + abs(o)) ELSE 0 END END AS cell_smape_pct,
  CASE WHEN v AND sum(abs(o)) FILTER (v) OVER w > 1e-12 THEN 100 * abs(p - o) / (sum(abs(o)) FILTER (v) OVER w) END AS wape_contribution_pct FROM ({PAIRED}) WINDOW w AS (PARTITION BY forecast_month, grp, variable)""", "ape_pct cell_smape_pct wape_contribution_pct")
def cell_metrics(f):
    return metrics.cell_metrics(f.pairs, KEYS).select(*KEYS, "lat_index", "lon_index", "metric_valid", "ape_pct", "cell_smape_pct", "wape_contribution_pct")


PRESENCE = "SELECT *, coalesce(predicted >= {T}, false) AS p, coalesce(observed >= {T}, false) AS o FROM {species_pairs}"


@query(f"SELECT *, {SCORES} FROM (SELECT forecast_month, {BINARY} FROM ({PRESENCE.replace('{T}', '0.5')}) GROUP BY ALL)", SCORE_COLUMNS)
def binary_scores(f):
    return metrics.binary_scores(f.species_pairs, ["forecast_month"], 0.5)


def _richness(t: str) -> str:
    cells = f"SELECT forecast_month, lat_index, lon_index, CAST(count(*) FILTER (p) AS DOUBLE) AS p, CAST(count(*) FILTER (o) AS DOUBLE) AS o, true AS v FROM ({PRESENCE.replace('{T}', t)}) GROUP BY ALL"
    rich = ", ".join(f"{c} AS richness_{c}" for c in "predicted_mean observed_mean mae rmse bias correlation wape_pct smape_pct rmae_pct cvrmse_pct cell_count".split())
    return f"SELECT b.*, r.* EXCLUDE (forecast_month), CAST({t} AS DOUBLE) AS threshold FROM (SELECT *, {SCORES} FROM (SELECT forecast_month, {BINARY} FROM ({PRESENCE.replace('{T}', t)}) GROUP BY ALL)) b JOIN (SELECT forecast_month, {rich} FROM (SELECT forecast_month, {METRICS} FROM ({cells}) GROUP BY ALL)) r USING (forecast_month)"


@query(f"{_richness('0.1')} UNION ALL {_richness('0.5')}", SCORE_COLUMNS + " " + " ".join(f"richness_{c}" for c in "predicted_mean observed_mean mae rmse bias correlation wape_pct smape_pct rmae_pct cvrmse_pct".split()))
def species_richness(f):
    return metrics.species_richness(f.species_pairs, ["forecast_month"], ["lat_index", "lon_index"])


_PROXY_CELLS = """SELECT forecast_month, lat_index, lon_index, CASE WHEN count(predicted) = count(*) THEN sum(predicted) END AS p1, CASE WHEN count(observed) = count(*) THEN sum(observed) END AS o1,
  CAST(count(*) FILTER (predicted >= 0.5) AS DOUBLE) AS p2, CAST(count(*) FILTER (observed >= 0.5) AS DOUBLE) AS o2, CAST(count(*) FILTER (predicted >= 0.1) AS DOUBLE) AS p3, CAST(count(*) FILTER (observed >= 0.1) AS DOUBLE) AS o3 FROM {species_pairs} GROUP BY ALL"""
_PROXY = " UNION ALL ".join(f"SELECT forecast_month, 'species_proxy' AS grp, '{n}' AS variable, p{k} AS p, o{k} AS o, p{k} IS NOT NULL AND o{k} IS NOT NULL AS v FROM ({_PROXY_CELLS})" for k, n in ((1, "species_sum_proxy"), (2, "species_count_threshold_0_5"), (3, "species_count_threshold_0_1")))


@query(f"SELECT forecast_month, grp, variable, {METRICS} FROM ({_PROXY}) GROUP BY ALL", METRIC_COLUMNS)
def species_proxy(f):
    return metrics.species_proxy(f.species_pairs, ["forecast_month"], ["lat_index", "lon_index"])


@query(f"""WITH p AS ({PAIRED}), a AS (SELECT * FROM {{areas}}), frame AS (SELECT area_label, forecast_month, grp, variable FROM (SELECT DISTINCT area_label FROM a) CROSS JOIN (SELECT DISTINCT forecast_month, grp, variable FROM p)),
  own AS (SELECT area_label, forecast_month, grp, variable, {METRICS} FROM p JOIN a ON {IN_AREA} GROUP BY ALL)
  SELECT forecast_month, grp, variable, area_label, coalesce(cell_count, 0) AS cell_count, coalesce(valid_cell_count, 0) AS valid_cell_count, mae, rmse, rmae_pct, coalesce(rmae_pct <= 3, false) AS within_3pct FROM frame LEFT JOIN own USING (area_label, forecast_month, grp, variable)
  UNION ALL SELECT forecast_month, grp, variable, 'full_grid', cell_count, valid_cell_count, mae, rmse, rmae_pct, coalesce(rmae_pct <= 3, false) FROM (SELECT forecast_month, grp, variable, {METRICS} FROM p GROUP BY ALL)""".replace("WITH p", "SELECT * FROM (WITH p") + ")", "mae rmse rmae_pct")
def area_summary(f):
    out = verify.area_summary(f.pairs, f.areas, KEYS)
    return out.select(*KEYS, "area_label", "cell_count", "valid_cell_count", "mae", "rmse", "rmae_pct", "within_3pct")


def _matrix(scope: str, where: str) -> str:
    return f"SELECT '{scope}' AS scope, * FROM (SELECT species, {METRICS} FROM (SELECT *, predicted AS p, observed AS o, predicted IS NOT NULL AND observed IS NOT NULL AS v FROM {{species_pairs}} WHERE {where}) GROUP BY ALL) JOIN (SELECT *, {SCORES} FROM (SELECT species, {BINARY} FROM ({PRESENCE.replace('{T}', '0.5')}) WHERE {where} GROUP BY ALL)) USING (species)"


@query(f"{_matrix('full_grid', 'true')} UNION ALL {_matrix('selected_area', 'lat_index BETWEEN 1 AND 2 AND lon_index BETWEEN 0 AND 0')}", METRIC_COLUMNS + " " + SCORE_COLUMNS)
def species_matrix(f):
    at = f.species_pairs.withColumns({"latitude": F.col("lat_index").cast("double"), "longitude": F.col("lon_index").cast("double")})
    return metrics.species_matrix(at, ["species"], {"min_lat": 1.0, "max_lat": 2.0, "min_lon": 0.0, "max_lon": 0.5})


BATCH = "SELECT month, CASE WHEN sum(w) <> 0 THEN sum(t2m * w) / sum(w) END - 273.15 AS temperature_mean_area_c, CASE WHEN sum(w) <> 0 THEN sum(tp * w) / sum(w) END * 1000 AS precipitation_mean_area_mm, count(*) AS cell_count FROM (SELECT *, cos(radians(latitude)) AS w FROM {grid_obs}) GROUP BY 1"


@query(BATCH, "temperature_mean_area_c precipitation_mean_area_mm")
def batch_area_summary(f):
    return observed.batch_area_summary(f.grid_obs, ["month"])


@query("SELECT forecast_month, count(*) FILTER (signal >= 0.5) AS species_count_area_proxy, max(signal) AS max_signal FROM (SELECT forecast_month, species, max(predicted) AS signal FROM {species_pairs} GROUP BY ALL) GROUP BY 1", "max_signal")
def batch_species_summary(f):
    return observed.batch_species_summary(f.species_pairs, ["forecast_month"])


@query(f"""WITH g AS (SELECT *, cos(radians(latitude)) AS w FROM {{grid_obs}}), a AS (SELECT * FROM {{areas}}),
  own AS (SELECT month, area_label, CASE WHEN sum(w) <> 0 THEN sum(t2m * w) / sum(w) END - 273.15 AS temperature_mean_area_c, CASE WHEN sum(w) <> 0 THEN sum(tp * w) / sum(w) END * 1000 AS precipitation_mean_area_mm, count(*) AS cell_count FROM g JOIN a ON {IN_AREA} GROUP BY ALL)
  SELECT month, area_label, temperature_mean_area_c, precipitation_mean_area_mm, coalesce(cell_count, 0) AS cell_count FROM (SELECT DISTINCT month FROM g) CROSS JOIN (SELECT DISTINCT area_label FROM a) LEFT JOIN own USING (month, area_label)""".replace("WITH g", "SELECT * FROM (WITH g") + ")", "temperature_mean_area_c precipitation_mean_area_mm")
def batch_areas(f):
    return summed.batch_areas(f.grid_obs, f.areas, ["month"])


@query(f"""WITH p AS (SELECT *, 40 + lat_index * CAST(0.25 AS DOUBLE) AS latitude, lon_index * CAST(0.25 AS DOUBLE) AS longitude FROM {{species_pairs}}), a AS (SELECT * FROM {{areas}}),
  own AS (SELECT forecast_month, area_label, species, max(predicted) AS signal FROM p JOIN a ON {IN_AREA} GROUP BY ALL)
  SELECT forecast_month, area_label, count(*) FILTER (signal >= 0.5) AS species_count_area_proxy, max(signal) AS max_signal FROM (SELECT DISTINCT forecast_month FROM p) CROSS JOIN (SELECT DISTINCT area_label FROM a) LEFT JOIN own USING (forecast_month, area_label) GROUP BY 1, 2""".replace("WITH p", "SELECT * FROM (WITH p") + ")", "max_signal")
def batch_species_areas(f):
    at = f.species_pairs.withColumns({"lat_i": F.col("lat_index") + 160, "lon_i": F.col("lon_index")})
    return summed.batch_species_areas(at, f.areas, ["forecast_month"])


@query("SELECT forecast_month, abs(avg(predicted) - avg(observed)) AS signal_delta, abs(max(predicted) - max(observed)) AS peak_delta FROM {species_pairs} GROUP BY 1", "signal_delta peak_delta")
def area_deltas(f):
    side = lambda c: f.species_pairs.groupBy("forecast_month").agg(F.avg(c).alias("signal"), F.max(c).alias("peak"))
    return observed.area_deltas(side("predicted"), side("observed"), ["forecast_month"], ["signal", "peak"])


def _pct(p: str, o: str) -> str:
    return f"CASE WHEN {p} IS NULL OR {o} IS NULL THEN NULL WHEN abs({o}) < 1e-12 THEN CASE WHEN abs({p}) < 1e-12 THEN 0 ELSE 100 END ELSE abs({p} - {o}) / abs({o}) * 100 END"


COMPARED = f"""SELECT *, predicted_mean - observed_mean AS bias, CASE WHEN variable = 't2m' THEN {_pct('(predicted_mean + 273.15)', '(observed_mean + 273.15)')} ELSE {_pct('predicted_mean', 'observed_mean')} END AS error_pct
  FROM (SELECT forecast_month, grp, variable, avg(predicted) AS predicted_mean, avg(observed) AS observed_mean, avg(abs(predicted - observed)) AS mae, sqrt(avg((predicted - observed) * (predicted - observed))) AS rmse FROM {{pairs}} GROUP BY ALL)"""


@query(COMPARED, "predicted_mean observed_mean mae rmse bias error_pct")
def variable_comparison(f):
    return metrics.variable_comparison(f.pairs, ["forecast_month"])


@query(f"SELECT forecast_month, grp, count(*) AS variable_count, avg(predicted_mean) AS mean_predicted, avg(observed_mean) AS mean_observed, avg(bias) AS mean_bias, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(error_pct) AS mean_error_pct FROM ({COMPARED}) GROUP BY ALL", "mean_predicted mean_observed mean_bias mean_mae mean_rmse mean_error_pct")
def group_comparison(f):
    return metrics.group_comparison(f.pairs, ["forecast_month"])


@query(f"""SELECT forecast_month, grp, variable, scenario, {METRICS} FROM (SELECT a.forecast_month, a.grp, a.variable, s.scenario, a.predicted AS p, b.observed AS o, a.predicted IS NOT NULL AND b.observed IS NOT NULL AND (a.variable <> 'NDVI' OR abs(b.observed) > 1e-12) AS v
  FROM {{pairs}} a CROSS JOIN (VALUES ('original', false, false), ('flip_lat', true, false), ('flip_lon', false, true), ('flip_both', true, true)) s(scenario, fa, fo)
  JOIN {{pairs}} b ON a.forecast_month = b.forecast_month AND a.grp = b.grp AND a.variable = b.variable AND b.lat_index = CASE WHEN fa THEN 4 - a.lat_index ELSE a.lat_index END AND b.lon_index = CASE WHEN fo THEN 4 - a.lon_index ELSE a.lon_index END) GROUP BY ALL""", METRIC_COLUMNS)
def alignment_scenarios(f):
    return metrics.alignment_scenarios(f.pairs, ["forecast_month"], 5, 5)


# grades, dashboards, validation

RELIABLE = """CASE WHEN grp = 'climate' AND variable = 't2m' THEN CASE WHEN mae <= 2 AND correlation >= 0.9 THEN 'alta' WHEN mae <= 3 AND correlation >= 0.75 THEN 'buona' WHEN mae <= 5 AND correlation >= 0.5 THEN 'media' ELSE 'bassa' END
  WHEN grp = 'climate' AND variable = 'tp' THEN CASE WHEN correlation >= 0.7 AND rmae_pct <= 50 THEN 'media-alta' WHEN correlation >= 0.4 AND rmae_pct <= 100 THEN 'media' ELSE 'bassa' END
  WHEN grp = 'species_proxy' THEN CASE WHEN correlation >= 0.7 AND rmae_pct <= 50 THEN 'promettente' WHEN correlation >= 0.4 THEN 'da verificare' ELSE 'debole' END
  ELSE CASE WHEN correlation >= 0.8 AND rmae_pct <= 25 THEN 'buona' WHEN correlation >= 0.5 THEN 'media' ELSE 'bassa/diagnostica' END END"""
READY = """CASE WHEN grp = 'climate' AND variable = 't2m' THEN CASE WHEN mae <= 2 AND abs(bias) <= 1 AND correlation >= 0.9 THEN 'ready_high' WHEN mae <= 3.5 AND abs(bias) <= 3 AND correlation >= 0.75 THEN 'usable_medium' ELSE 'needs_calibration' END
  WHEN grp = 'climate' AND variable = 'tp' THEN CASE WHEN correlation >= 0.6 AND rmae_pct <= 100 AND abs(bias) <= 2 THEN 'diagnostic_medium' ELSE 'weak_precipitation' END
  WHEN grp = 'species_proxy' THEN 'exploratory_not_final' WHEN grp = 'species' THEN 'exploratory_species_map'
  WHEN grp = 'vegetation' AND variable = 'NDVI' THEN CASE WHEN correlation >= 0.7 THEN 'diagnostic_promising' ELSE 'diagnostic_uncertain' END
  WHEN grp IN ('forest', 'agriculture', 'redlist') THEN CASE WHEN correlation >= 0.7 THEN 'context_spatially_consistent' ELSE 'context_uncertain' END
  WHEN grp IN ('edaphic', 'misc', 'atmospheric', 'climate') THEN CASE WHEN correlation >= 0.75 THEN 'diagnostic_spatially_consistent' ELSE 'diagnostic_uncertain' END ELSE 'native_metric_only' END"""
_META = "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in verify.METADATA) + ") m(grp, variable, d, u, i, ro)"
_GROUP = "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in verify.GROUP_METADATA) + ") g(grp, d, u, i, ro)"
_TOLD = ", ".join(f"coalesce(m.{k}, g.{k}, '{d}') AS {n}" for k, n, d in zip(("d", "u", "i", "ro"), verify.TOLD, verify.DEFAULT_METADATA))
WITH_META = f"SELECT r.*, {_TOLD} FROM (SELECT *, 'native' AS unit, {READY} AS readiness FROM ({METRIC_ROWS})) r LEFT JOIN {_META} USING (grp, variable) LEFT JOIN {_GROUP} ON g.grp = r.grp"


def graded(f):
    return verify.attach_metadata(metric_rows(f).withColumn("unit", F.lit("native")).withColumn("readiness", verify.readiness()))


@query(f"SELECT forecast_month, grp, variable, {RELIABLE} AS reliability FROM ({METRIC_ROWS})")
def reliability(f):
    return metric_rows(f).select(*KEYS, verify.reliability().alias("reliability"))


@query(f"SELECT forecast_month, grp, variable, readiness, domain, \"use\", interpretation, role FROM ({WITH_META})")
def readiness(f):
    return graded(f).select(*KEYS, "readiness", "domain", "use", "interpretation", "role")


_MEANS = "predicted_mean observed_mean mae rmse bias wape_pct smape_pct rmae_pct cvrmse_pct".split()
BOARD = f"""SELECT *, ready_or_usable_months::DOUBLE / nullif(n_months, 0) AS readiness_ratio FROM (SELECT grp, variable, unit, domain, "use", count(DISTINCT forecast_month) AS n_months, {", ".join(f"avg({c}) AS {c if c.endswith('_mean') else 'mean_' + c}" for c in _MEANS)}, avg(abs(bias)) AS mean_abs_bias,
  avg(correlation) AS mean_corr, quantile_cont(correlation, 0.5) AS median_corr, avg(correlation * correlation) AS mean_r2_corr_squared, count(DISTINCT CASE WHEN readiness IN {verify.READY_STATES} THEN forecast_month END) AS ready_or_usable_months FROM ({WITH_META}) GROUP BY ALL)"""
BOARD_COLUMNS = " ".join(c if c.endswith("_mean") else f"mean_{c}" for c in _MEANS) + " mean_abs_bias mean_corr median_corr mean_r2_corr_squared readiness_ratio"


@query(BOARD, BOARD_COLUMNS)
def dashboard(f):
    return verify.dashboard(graded(f))


@query(f"""SELECT grp, variable, domain, "use", interpretation, role, n_months, mean_mae, mean_corr, readiness_ratio, CASE WHEN readiness_ratio >= 0.8 THEN 'high_or_context_ready' WHEN readiness_ratio >= 0.4 THEN 'medium_promising' WHEN "use" IN ('context_layer', 'diagnostic', 'technical_context') THEN 'context_or_diagnostic' ELSE 'exploratory' END AS validation_state
  FROM (SELECT b.* EXCLUDE (domain, "use"), {_TOLD} FROM ({BOARD}) b LEFT JOIN {_META} USING (grp, variable) LEFT JOIN {_GROUP} ON g.grp = b.grp)""", "mean_mae mean_corr readiness_ratio")
def indicator_map(f):
    return verify.indicator_map(verify.dashboard(graded(f))).select("grp", "variable", "domain", "use", "interpretation", "role", "n_months", "mean_mae", "mean_corr", "readiness_ratio", "validation_state")


@query("SELECT CAST(year(forecast_month) AS INT) AS year, count(DISTINCT forecast_month) AS n_months, array_to_string(list_sort(list(DISTINCT month(forecast_month))), ', ') AS months FROM {pairs} GROUP BY 1")
def coverage(f):
    return verify.coverage(f.pairs)


_CURATED = ", ".join(f"avg({c}) AS {c}" for c in verify.CURATED_MEANS)


@query(f"SELECT grp, variable, forecast_month, {_CURATED} FROM ({METRIC_ROWS}) GROUP BY ALL", " ".join(verify.CURATED_MEANS))
def curated_by_month(f):
    return verify.curated_by_month(metric_rows(f))


@query(f"SELECT grp, variable, CAST(year(forecast_month) AS INT) AS year, {_CURATED} FROM ({METRIC_ROWS}) GROUP BY grp, variable, year(forecast_month)", " ".join(verify.CURATED_MEANS))
def curated_by_year(f):
    return verify.curated_by_year(verify.curated_by_month(metric_rows(f)))


_CASES = f"""SELECT *, coalesce(temperature_error_pct_kelvin <= 3, false) AS temperature_pass, coalesce(precipitation_error_pct <= 3, false) AS precipitation_pass, coalesce(species_error_pct_proxy <= 3, false) AS species_pass, coalesce(temperature_error_pct_kelvin <= 3 AND precipitation_error_pct <= 3 AND species_error_pct_proxy <= 3, false) AS overall_pass FROM (SELECT city, case_id,
  abs(temperature_predicted_c - temperature_observed_c) AS temperature_abs_error_c, {_pct('(temperature_predicted_c + 273.15)', '(temperature_observed_c + 273.15)')} AS temperature_error_pct_kelvin, abs(precipitation_predicted_mm - precipitation_observed_mm) AS precipitation_abs_error_mm, {_pct('precipitation_predicted_mm', 'precipitation_observed_mm')} AS precipitation_error_pct,
  abs(species_predicted_proxy - species_observed_proxy) AS species_abs_error_proxy, {_pct('species_predicted_proxy', 'species_observed_proxy')} AS species_error_pct_proxy FROM {{cases}})"""
_ERRORS = ("temperature_abs_error_c", "temperature_error_pct_kelvin", "precipitation_abs_error_mm", "precipitation_error_pct", "species_abs_error_proxy", "species_error_pct_proxy")


@query(_CASES, " ".join(_ERRORS))
def case_validation(f):
    return verify.case_validation(f.cases).select("city", "case_id", *_ERRORS, "temperature_pass", "precipitation_pass", "species_pass", "overall_pass")


@query(f"SELECT city, count(*) AS case_count, {', '.join(f'avg({c}) AS mean_{c}' for c in _ERRORS)}, avg(CAST(overall_pass AS INT)) * 100 AS overall_pass_rate_pct FROM ({_CASES}) GROUP BY 1", " ".join(f"mean_{c}" for c in _ERRORS) + " overall_pass_rate_pct")
def by_city(f):
    return verify.by_city(verify.case_validation(f.cases))


@query(f"SELECT count(*) AS case_count, count(DISTINCT city) AS city_count, count(*) FILTER (overall_pass) AS overall_pass_count, avg(CAST(overall_pass AS INT)) * 100 AS overall_pass_rate_pct, avg(temperature_error_pct_kelvin) AS temperature_mean_error_pct_kelvin, avg(precipitation_error_pct) AS precipitation_mean_error_pct, avg(species_error_pct_proxy) AS species_mean_error_pct_proxy FROM ({_CASES})", "overall_pass_rate_pct temperature_mean_error_pct_kelvin precipitation_mean_error_pct species_mean_error_pct_proxy")
def validation_summary(f):
    return verify.validation_summary(verify.case_validation(f.cases))


@query(f"SELECT forecast_month, grp, variable, level, {METRICS} FROM (SELECT * REPLACE (CASE WHEN lat_index = 0 THEN level END AS level) FROM ({PAIRED})) GROUP BY ALL ORDER BY forecast_month NULLS LAST, grp NULLS LAST, variable NULLS LAST, level NULLS LAST", METRIC_COLUMNS)
def sort_metrics(f):
    told = metrics.continuous_metrics(f.pairs.withColumn("level", F.when(F.col("lat_index") == 0, F.col("level"))), [*KEYS, "level"])
    return metrics.sort_metrics(told)


@query("""SELECT p.run_id, p.forecast_month, p.variable, p.lat_index, p.lon_index, p.predicted, o.observed FROM (SELECT run_id, forecast_month, variable, predicted, CASE WHEN month(forecast_month) % 3 = 0 THEN 4 - lat_index ELSE lat_index END AS lat_index, CASE WHEN month(forecast_month) % 2 = 0 THEN 4 - lon_index ELSE lon_index END AS lon_index FROM {pairs}) p
  JOIN {pairs} o ON p.run_id = o.run_id AND p.variable = o.variable AND p.lat_index = o.lat_index AND p.lon_index = o.lon_index""", "predicted observed")
def pair_runs(f):
    m = F.month("forecast_month")
    runs = f.pairs.select("run_id", "forecast_month").distinct().select("run_id", F.when(m % 3 != 1, m % 3 == 0).alias("latitude_flip"), (m % 2 == 0).alias("longitude_flip"))
    return verify.pair_runs(f.pairs, f.pairs, runs, ["forecast_month", "variable"], size=(5, 5))


@query("SELECT variable, year, count(*) FILTER (g.lat_i IS NOT NULL) AS matched, count(*) FILTER (g.lat_i IS NULL) AS skipped FROM (SELECT DISTINCT variable, year, lat_i, lon_i FROM {land_long} WHERE value IS NOT NULL) l LEFT JOIN (SELECT DISTINCT lat_i, lon_i FROM {grid_obs} WHERE lsm > 0.5) g ON l.lat_i = g.lat_i AND l.lon_i = g.lon_i GROUP BY 1, 2")
def model_grid_counts(f):
    return grid.model_grid_counts(f.land_long, f.grid_obs.where("lsm > 0.5"), "value", ("variable", "year"))


@query("SELECT run_id, forecast_month, path FROM (SELECT *, row_number() OVER (PARTITION BY forecast_month ORDER BY ends_with(run_id, ' 4'), path) AS n FROM {runs} WHERE checkpoint = 'small') WHERE n = 1")
def select_runs(f):
    return verify.select_runs(f.runs, "small").select("run_id", "forecast_month", "path")


@query("SELECT run_id, checkpoint, price, seq, batch FROM (SELECT *, row_number() OVER (PARTITION BY run_id, checkpoint ORDER BY seq DESC) AS n FROM (SELECT run_id, checkpoint, price, seq, CASE WHEN seq % 2 = 1 THEN 'new' END AS batch FROM {runs})) WHERE n = 1")
def history_upsert(f):
    rows = f.runs.select("run_id", "checkpoint", "price", "seq")
    return verify.history_upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1").withColumn("batch", F.lit("new")), ["run_id", "checkpoint"])


@query(f"SELECT forecast_month, variable, mae, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY forecast_month ORDER BY mae DESC NULLS LAST, variable) AS n FROM ({COMPARED})) WHERE n <= 3", "mae")
def top_species(f):
    return verify.top_species(metrics.variable_comparison(f.pairs, ["forecast_month"]), 3, ["forecast_month"]).select("forecast_month", "variable", "mae", "rank")


@query("SELECT area_label FROM (SELECT *, row_number() OVER (PARTITION BY min_lat, max_lat, min_lon, max_lon ORDER BY seq) AS n FROM {areas}) WHERE n = 1")
def dedupe_areas(f):
    return verify.dedupe_areas(f.areas).select("area_label")


_SANITY = "SELECT seq, path AS prediction_path, CASE WHEN seq % 4 = 0 THEN path ELSE concat(path, 'o') END AS observed_path, forecast_month, forecast_month AS predicted_last_month, CASE WHEN seq % 3 = 0 THEN NULL ELSE forecast_month END AS observed_last_month, price AS input_last_month, CASE WHEN seq % 5 = 0 THEN price + 1 ELSE price END AS observed_previous_month, 1 AS lead_predicted, CAST(1 + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS INT) AS lead_observed, price - price AS t2m_mae, CASE WHEN seq % 2 = 0 THEN price ELSE 0 END AS tp_mae FROM {runs}"


@query(f"SELECT seq, coalesce(prediction_path <> observed_path, false) AS paths_differ, observed_last_month IS NOT DISTINCT FROM forecast_month AS observed_month_ok, observed_previous_month IS NOT DISTINCT FROM input_last_month AS input_alignment_ok, lead_predicted = lead_observed AS lead_time_match, abs(t2m_mae) < 1e-8 AND abs(tp_mae) < 1e-8 AS identical_maps, coalesce(prediction_path <> observed_path, false) AND observed_last_month IS NOT DISTINCT FROM forecast_month AND observed_previous_month IS NOT DISTINCT FROM input_last_month AND lead_predicted = lead_observed AS sanity_pass FROM ({_SANITY})")
def run_sanity(f):
    runs = f.spark.sql(_SANITY, runs=f.runs)
    return verify.run_sanity(runs).select("seq", "paths_differ", "observed_month_ok", "input_alignment_ok", "lead_time_match", "identical_maps", "sanity_pass")


_STATUS = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in verify.SOURCE_STATUS) + ") s(grp, clean, rest)"


@query(f"SELECT seq, grp, CASE WHEN grp = 'atmospheric' THEN CASE WHEN atmosphere THEN 'real' ELSE 'placeholder_zero_fast_smoke_test' END WHEN input_mode = 'clean' THEN clean ELSE rest END AS source_status FROM {{runs}} CROSS JOIN {_STATUS}")
def source_status(f):
    return verify.source_status(f.runs).select("seq", "grp", "source_status")


# observed assessment end to end

_CELLS = f"""SELECT g.month, g.lat_i, g.lon_i, g.t2m - 273.15 AS temperature_mean_c, g.avg_tprate * 86400 * {DAYS.replace('month', 'g.month')} AS precipitation_mean_mm, g.avg_tprate * 86400 AS precipitation_mean_daily_mm, g.swvl1 AS swvl1_mean, g.swvl2 AS swvl2_mean, g.stl1 - 273.15 AS stl1_mean, g.stl2 - 273.15 AS stl2_mean,
  coalesce(g.ndvi, {GREEN}) AS ndvi_mean, cr.value AS cropland_mean, ar.value AS arable_mean, fo.value AS forest_mean, sp.species_count AS species_count_observed_cell, cos(radians(g.latitude)) AS latitude_weight
  FROM {{grid_obs}} g SEMI JOIN ({LAND}) l ON g.lat_i = l.lat_i AND g.lon_i = l.lon_i LEFT JOIN ({ASOF.replace('VAR', 'Cropland')}) cr ON cr.month = g.month AND cr.lat_i = g.lat_i AND cr.lon_i = g.lon_i LEFT JOIN ({ASOF.replace('VAR', 'Arable')}) ar ON ar.month = g.month AND ar.lat_i = g.lat_i AND ar.lon_i = g.lon_i
  LEFT JOIN ({ASOF.replace('VAR', 'Agriculture')}) fo ON fo.month = g.month AND fo.lat_i = g.lat_i AND fo.lon_i = g.lon_i LEFT JOIN (SELECT month, lat_i, lon_i + 17 AS lon_i, species_count FROM ({SPECIES_CELL})) sp ON sp.month = g.month AND sp.lat_i = g.lat_i AND sp.lon_i = g.lon_i
  WHERE coalesce(g.t2m, g.avg_tprate, g.swvl1, g.swvl2, g.stl1, g.stl2) IS NOT NULL"""
_WIDE = "temperature_mean_c precipitation_mean_mm precipitation_mean_daily_mm swvl1_mean swvl2_mean stl1_mean stl2_mean ndvi_mean cropland_mean arable_mean forest_mean"


def cells_of(f):
    species = observed.species_cell_month(f.occ).withColumn("lon_i", F.col("lon_i") + 17)
    # both greenness sources are columns of one table, so the fallback needs no join
    climate = f.grid_obs.withColumn("ndvi_mean", F.coalesce("ndvi", observed.ndvi_from_lai()))
    layers = observed.yearly_asof_wide(f.land_long, f.months, {"Cropland": "cropland_mean", "Arable": "arable_mean", "Agriculture": "forest_mean"})
    return observed.cell_month(climate, species, layers)


@query(f"SELECT month, lat_i, lon_i, {', '.join(_WIDE.split())}, species_count_observed_cell FROM ({_CELLS})", _WIDE)
def cell_month(f):
    return cells_of(f).select("month", "lat_i", "lon_i", *_WIDE.split(), "species_count_observed_cell")


def _wmean(c: str) -> str:
    return f"CASE WHEN sum(CASE WHEN {c} IS NOT NULL THEN latitude_weight END) <> 0 THEN sum({c} * latitude_weight) / sum(CASE WHEN {c} IS NOT NULL THEN latitude_weight END) END AS {c.replace('_mean', '_mean_area', 1)}"


_AREA = f"SELECT month, {', '.join(map(_wmean, observed.AREA_MEANS))}, count(*) FILTER (coalesce({', '.join(c for c in observed.AREA_MEANS if c != 'precipitation_mean_daily_mm')}) IS NOT NULL) AS valid_cell_count, count(*) AS cell_count_land, count(*) FILTER (species_count_observed_cell > 0) AS cells_with_species_records FROM ({_CELLS}) GROUP BY 1"
_AREA_COLUMNS = " ".join(c.replace("_mean", "_mean_area", 1) for c in observed.AREA_MEANS)


@query(f"SELECT * FROM ({_AREA}) FULL JOIN (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT species) AS species_count_observed_area FROM {{occ}} GROUP BY 1) USING (month)", _AREA_COLUMNS)
def area_month(f):
    return observed.area_with_species(observed.area_month(cells_of(f)), observed.species_area_month(f.occ))


@query("SELECT month, CASE WHEN sum(CASE WHEN t2m IS NOT NULL THEN w END) <> 0 THEN sum(t2m * w) / sum(CASE WHEN t2m IS NOT NULL THEN w END) END AS t2m_mean FROM (SELECT *, cos(radians(latitude)) AS w FROM {grid_obs}) GROUP BY 1", "t2m_mean")
def weighted_mean(f):
    return grid.cell_keys(f.grid_obs).groupBy("month").agg(observed.weighted_mean("t2m").alias("t2m_mean"))


@query(f"SELECT month, sum(t2m * w) / nullif(sum(CASE WHEN t2m IS NOT NULL THEN w END), 0) - 273.15 AS value FROM (SELECT *, cos(radians(latitude)) AS w FROM {{grid_obs}} SEMI JOIN ({LAND}) l USING (lat_i, lon_i)) GROUP BY 1", "value")
def weighted_land_series(f):
    return observed.weighted_land_series(f.grid_obs, "t2m", lambda c: c - 273.15)


@query("SELECT variable, month, lat_i, lon_i, value FROM (SELECT variable, month, lat_i, lon_i, value, row_number() OVER (PARTITION BY variable, month, lat_i, lon_i ORDER BY valid_time) AS n FROM (SELECT 'price' AS variable, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_custkey % 30 AS INT) AS lat_i, 0 AS lon_i, o_orderkey AS valid_time, o_totalprice AS value FROM orders)) WHERE n = 1")
def first_matching_step(f):
    steps = f.orders.select(F.lit("price").alias("variable"), months.month_start("o_orderdate").alias("month"), (F.col("o_custkey") % 30).cast("int").alias("lat_i"), F.lit(0).alias("lon_i"), F.col("o_orderkey").alias("valid_time"), F.col("o_totalprice").alias("value"))
    return observed.first_matching_step(steps).drop("valid_time")


# forecast cells

_PIVOT = f"SELECT month, lat_i, lon_i, {', '.join(f'max(value) FILTER (variable = {chr(39)}{v}{chr(39)}) AS {v}' for v in ('temperature', 'tp', 'swvl1', 'stl1'))} FROM ({GUARDED}) GROUP BY ALL"


@query(_PIVOT, "temperature tp swvl1 stl1")
def forecast_cells(f):
    return reshape.forecast_cells(quality.kelvin_guard(layers(f)), ["temperature", "tp", "swvl1", "stl1"])


_FMEANS = ("temperature", "tp", "swvl1", "stl1")


@query(f"SELECT month, {', '.join(_wmean(c) for c in _FMEANS)}, count(*) FILTER (coalesce(temperature, tp, swvl1, stl1) IS NOT NULL) AS valid_cell_count, count(*) AS cell_count_land FROM (SELECT *, cos(radians(lat_i * CAST(0.25 AS DOUBLE))) AS latitude_weight FROM ({_PIVOT})) GROUP BY 1", "temperature tp swvl1 stl1")
def forecast_area_month(f):
    cells = reshape.forecast_cells(quality.kelvin_guard(layers(f)), list(_FMEANS))
    at = cells.withColumns({"latitude": F.col("lat_i") * 0.25, "longitude": F.col("lon_i") * 0.25})
    return observed.area_month(grid.cell_keys(at), means=_FMEANS)


@query(f"""SELECT forecast_month, grp, variable, latitude AS lat, longitude AS lon, p AS predicted_NDVI_native, o AS observed_NDVI_native, p - o AS difference_NDVI_native, abs(p - o) AS abs_error_NDVI_native, latitude BETWEEN 40.25 AND 40.75 AND longitude BETWEEN 0.25 AND 0.75 AS inside_selected_area,
  v AS metric_valid, CASE WHEN v AND abs(o) > 1e-12 THEN 100 * abs(p - o) / abs(o) END AS ape_pct, CASE WHEN v THEN CASE WHEN abs(p) + abs(o) > 1e-12 THEN 200 * abs(p - o) / (abs(p) + abs(o)) ELSE 0 END END AS cell_smape_pct,
  CASE WHEN v AND sum(abs(o)) FILTER (v) OVER w > 1e-12 THEN 100 * abs(p - o) / (sum(abs(o)) FILTER (v) OVER w) END AS wape_contribution_pct, wape_pct, rmae_pct, cvrmse_pct
  FROM ({PAIRED}) JOIN (SELECT forecast_month, grp, variable, wape_pct, rmae_pct, cvrmse_pct FROM ({METRIC_ROWS})) USING (forecast_month, grp, variable) WHERE variable = 'NDVI' WINDOW w AS (PARTITION BY forecast_month, grp, variable)""", "predicted_NDVI_native observed_NDVI_native difference_NDVI_native abs_error_NDVI_native ape_pct cell_smape_pct wape_contribution_pct wape_pct rmae_pct cvrmse_pct")
def cell_matrix(f):
    return metrics.cell_matrix(f.pairs, KEYS, "NDVI", "native", {"min_lat": 40.25, "max_lat": 40.75, "min_lon": 0.25, "max_lon": 0.75})


@query("SELECT month, latitude, longitude, printf('%.2f_%.2f', latitude, longitude) AS cell_id, cos(radians(latitude)) AS latitude_weight, CAST(NULL AS BIGINT) AS species_count_observed_cell, temperature AS temperature_mean_c, CAST(NULL AS DOUBLE) AS ndvi_mean, swvl1 AS swvl1_mean, CAST(NULL AS DOUBLE) AS swvl2_mean, stl1 AS stl1_mean, CAST(NULL AS DOUBLE) AS stl2_mean, CAST(NULL AS DOUBLE) AS cropland_mean, CAST(NULL AS DOUBLE) AS arable_mean, CAST(NULL AS DOUBLE) AS forest_mean FROM (SELECT *, lat_i * CAST(0.25 AS DOUBLE) AS latitude, lon_i * CAST(0.25 AS DOUBLE) AS longitude FROM (" + _PIVOT + ")) WHERE latitude BETWEEN 41 AND 43 AND longitude BETWEEN 1 AND 3", "temperature_mean_c swvl1_mean stl1_mean latitude_weight")
def forecast_month_cells(f):
    known = quality.kelvin_guard(layers(f)).where("variable <> 'tp'")
    return reshape.forecast_month_cells(known, {"min_lat": 41.0, "max_lat": 43.0, "min_lon": 1.0, "max_lon": 3.0})


@query("SELECT month, lat_i, lon_i, max(value) FILTER (variable = 't2m') AS t2m_native, max(value) FILTER (variable = 'swvl1') AS swvl1_native FROM {grid_long} GROUP BY ALL", "t2m_native swvl1_native")
def group_wide(f):
    return reshape.group_wide(f.grid_long.withColumnRenamed("variable", "name"), ["month", "lat_i", "lon_i"], ["t2m", "swvl1"])


@query("SELECT v.grp, v.variable, c.lat_i, c.lon_i, CASE WHEN v.grp = 'misc' THEN 0 ELSE coalesce(g.value, 0) END AS value FROM (SELECT DISTINCT lat_i, lon_i FROM {grid_obs}) c CROSS JOIN (VALUES ('climate', 't2m'), ('edaphic', 'stl1'), ('misc', 'avg_pevr'), ('surface', 'lsm'), ('land', 'Land')) v(grp, variable) LEFT JOIN (SELECT grp, variable, lat_i, lon_i, value FROM {grid_long} WHERE month = DATE '1997-05-01' UNION ALL SELECT CASE n WHEN 1 THEN 'surface' ELSE 'land' END, CASE n WHEN 1 THEN 'lsm' ELSE 'Land' END, lat_i, lon_i, lsm FROM {grid_obs} CROSS JOIN (VALUES (1), (2)) t(n) WHERE month = DATE '1997-05-01') g ON g.grp = v.grp AND g.variable = v.variable AND g.lat_i = c.lat_i AND g.lon_i = c.lon_i", "value")
def dense_batch(f):
    listed = f.spark.createDataFrame([("climate", "t2m"), ("edaphic", "stl1"), ("misc", "avg_pevr"), ("surface", "lsm"), ("land", "Land")], "grp string, variable string")
    groups = f.grid_long.where("month = date '1997-05-01'").select("grp", "variable", "lat_i", "lon_i", "value")
    groups = groups.unionByName(f.grid_obs.where("month = date '1997-05-01'").select(F.lit("surface").alias("grp"), F.lit("lsm").alias("variable"), "lat_i", "lon_i", F.col("lsm").alias("value")))
    return quality.dense_batch(groups, f.grid_obs.select("lat_i", "lon_i").distinct(), listed)


@query("SELECT v.grp, v.variable, c.lat_i, c.lon_i, CASE WHEN v.grp = 'vegetation' THEN 0 ELSE coalesce(g.t2m, 0) END AS value FROM (SELECT DISTINCT lat_i, lon_i FROM {grid_obs}) c CROSS JOIN (VALUES ('climate', 't2m'), ('vegetation', 'NDVI')) v(grp, variable) LEFT JOIN (SELECT * FROM {grid_obs} WHERE month = DATE '1997-05-01') g ON g.lat_i = c.lat_i AND g.lon_i = c.lon_i", "value")
def dense_batch_clean(f):
    listed = f.spark.createDataFrame([("climate", "t2m"), ("vegetation", "NDVI")], "grp string, variable string")
    month = f.grid_obs.where("month = date '1997-05-01'")
    of = lambda g, v, c: month.select(F.lit(g).alias("grp"), F.lit(v).alias("variable"), "lat_i", "lon_i", F.col(c).alias("value"))
    return quality.dense_batch(of("climate", "t2m", "t2m").unionByName(of("vegetation", "NDVI", "ndvi")), f.grid_obs.select("lat_i", "lon_i").distinct(), listed, "clean")


_LISTED = "(VALUES ('climate', 't2m', NULL), ('edaphic', 'stl1', NULL), ('misc', 'avg_pevr', NULL), ('surface', 'lsm', NULL), ('land', 'Land', NULL), ('atmospheric', 'q', 850), ('atmospheric', 'q', 500), ('atmospheric', 'z', 1000)) v(grp, variable, level)"


@query(f"""SELECT m.month, v.grp, v.variable, CAST(v.level AS INT) AS level, c.lat_i, c.lon_i, CASE WHEN v.grp = 'misc' THEN 0 ELSE coalesce(g.value, 0) END AS value
  FROM (SELECT DISTINCT month FROM {{grid_obs}}) m CROSS JOIN (SELECT DISTINCT lat_i, lon_i FROM {{grid_obs}}) c CROSS JOIN {_LISTED}
  LEFT JOIN (SELECT month, grp, variable, NULL AS level, lat_i, lon_i, value FROM {{grid_long}} UNION ALL SELECT month, CASE n WHEN 1 THEN 'surface' ELSE 'land' END, CASE n WHEN 1 THEN 'lsm' ELSE 'Land' END, NULL, lat_i, lon_i, lsm FROM {{grid_obs}} CROSS JOIN (VALUES (1), (2)) t(n)
    UNION ALL SELECT month, 'atmospheric', 'q', 850, lat_i, lon_i, swvl2 FROM {{grid_obs}}) g
  ON g.month = m.month AND g.grp = v.grp AND g.variable = v.variable AND g.level IS NOT DISTINCT FROM v.level AND g.lat_i = c.lat_i AND g.lon_i = c.lon_i""", "value")
def dense_batches(f):
    flat, air = (("climate", "t2m"), ("edaphic", "stl1"), ("misc", "avg_pevr"), ("surface", "lsm"), ("land", "Land")), (("atmospheric", "q", [850, 500]), ("atmospheric", "z", [1000]))
    listed = f.spark.createDataFrame([(*v, None) for v in flat] + list(air), "grp string, variable string, levels array<int>")
    no, cell = F.lit(None).cast("int").alias("level"), ("lat_i", "lon_i")
    known = f.grid_long.select("month", "grp", "variable", no, *cell, "value")
    known = known.unionByName(f.grid_obs.select("month", F.lit("surface").alias("grp"), F.lit("lsm").alias("variable"), no, *cell, F.col("lsm").alias("value")))
    known = known.unionByName(f.grid_obs.select("month", F.lit("atmospheric").alias("grp"), F.lit("q").alias("variable"), F.lit(850).alias("level"), *cell, F.col("swvl2").alias("value")))
    return quality.dense_batches(known, f.grid_obs.select(*cell).distinct(), listed, f.grid_obs.select("month"))


# land cover


@query("SELECT lat_i, lon_i, arg_max(v, tile_seq) AS value, max(tile_seq) AS tile_seq FROM (SELECT tile_seq, CAST(round_even(latitude * 4, 0) AS INT) AS lat_i, CAST(round_even(longitude * 4, 0) AS INT) AS lon_i, avg(CASE WHEN value BETWEEN 0 AND 100 AND value <> nodata THEN value END) AS v FROM {pixels} GROUP BY ALL HAVING v IS NOT NULL) GROUP BY ALL", "value")
def regrid_pixels(f):
    return landcover.regrid_pixels(f.pixels.withColumn("value", landcover.valid_range("value", "nodata")))


def _upsert(order: str) -> str:
    return f"SELECT coalesce(a.lat_i, b.lat_i) AS lat_i, coalesce(a.lon_i, b.lon_i) AS lon_i, coalesce({order}) AS value FROM (SELECT * FROM {{land_long}} WHERE variable = 'Arable' AND year = 1999) a FULL JOIN (SELECT * FROM {{land_long}} WHERE variable = 'Arable' AND year = 2000) b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i"


@query(f"SELECT *, true AS overwrite FROM ({_upsert('b.value, a.value')}) UNION ALL SELECT *, false FROM ({_upsert('a.value, b.value')})", "value")
def yearly_upsert(f):
    of = lambda y: f.land_long.where(f"variable = 'Arable' and year = {y}")
    both = [landcover.upsert_year(of(1999), of(2000), ["lat_i", "lon_i"], w).withColumn("overwrite", F.lit(w)) for w in (True, False)]
    return both[0].unionByName(both[1])


@query("""SELECT latitude, longitude, variable, year, value, 'official' AS mode, year AS source_year FROM {land_long} UNION ALL
  SELECT l.latitude, l.longitude, l.variable, y.year, l.value, 'carry_forward', l.year FROM {land_long} l JOIN (SELECT variable, max(year) AS last FROM {land_long} WHERE year <= 2000 GROUP BY 1) m ON l.variable = m.variable AND l.year = m.last CROSS JOIN (VALUES (2002), (2003)) y(year)""", "value")
def carry_forward(f):
    years = f.spark.createDataFrame([(2001,), (2002,), (2003,)], "year int")
    return landcover.carry_forward(f.land_long.drop("lat_i", "lon_i"), years, 2000)


_YEARS = (1995, 1996, 1997, 1999)


@query(f"SELECT latitude, longitude, variable, {', '.join(f'max(value) FILTER (year = {y}) AS Agri_{y}' for y in _YEARS)} FROM {{land_long}} GROUP BY ALL", " ".join(f"Agri_{y}" for y in _YEARS))
def yearly_pivot(f):
    return landcover.sort_landcover(reshape.long_to_yearly_wide(f.land_long, "Agri", ["latitude", "longitude", "variable"], list(_YEARS)))


@query(f"SELECT latitude, longitude, variable, year, value FROM (SELECT p.latitude, p.longitude, p.variable, y.year, l.value FROM (SELECT DISTINCT latitude, longitude, variable FROM {{land_long}}) p CROSS JOIN (VALUES (1995), (1996), (1997), (1999)) y(year) LEFT JOIN {{land_long}} l ON l.latitude = p.latitude AND l.longitude = p.longitude AND l.variable = p.variable AND l.year = y.year)", "value")
def yearly_unpivot(f):
    keys = ["latitude", "longitude", "variable"]
    return reshape.yearly_wide_to_long(reshape.long_to_yearly_wide(f.land_long, "Agri", keys, list(_YEARS)), "Agri", keys)


@query("SELECT lat_i, lon_i, m AS month, max(ndvi) FILTER (month = m) AS value FROM {grid_obs} CROSS JOIN (VALUES (DATE '1996-01-01'), (DATE '1996-02-01')) v(m) GROUP BY ALL", "value")
def monthly_unpivot(f):
    when = lambda m: F.max(F.when(F.col("month") == F.lit(m).cast("date"), F.col("ndvi")))
    wide = f.grid_obs.groupBy("lat_i", "lon_i").agg(when("1996-01-01").alias("NDVI_01/1996"), when("1996-02-01").alias("ndvi_1996-02"))
    return reshape.monthly_wide_to_long(wide, "NDVI", ["lat_i", "lon_i"])


@query("SELECT c_custkey, make_date(1995 + CAST(c_custkey % 5 AS INT), CAST(1 + c_custkey % 12 AS INT), 1) AS month, c_acctbal AS value FROM customer")
def monthly_long(f):
    c = F.col("c_custkey")
    names = F.array(*map(F.lit, "jan February 3 apr May 06 jul Aug september Oct Nov december".split()))
    table = f.customer.select("c_custkey", (1995 + c % 5).cast("string").alias("Year"), F.element_at(names, (1 + c % 12).cast("int")).alias("Month"), F.col("c_acctbal").alias("NDVI_mean"))
    return reshape.monthly_long(table, "NDVI", ["c_custkey"])


@query("SELECT year, mode, source_year, source_file, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ingested_at DESC) AS n FROM (SELECT CAST(1995 + o_custkey % 7 AS INT) AS year, o_orderstatus AS mode, CAST(1995 + o_custkey % 7 AS INT) AS source_year, o_orderpriority AS source_file, o_orderkey AS ingested_at FROM orders)) WHERE n = 1")
def provenance(f):
    year = (1995 + F.col("o_custkey") % 7).cast("int")
    rows = f.orders.select(year.alias("year"), F.col("o_orderstatus").alias("mode"), year.alias("source_year"), F.col("o_orderpriority").alias("source_file"), F.col("o_orderkey").alias("ingested_at"))
    return landcover.provenance(rows.where("ingested_at % 2 = 0"), rows.where("ingested_at % 2 = 1"))


# trends

_POS = "SELECT *, CAST(row_number() OVER (PARTITION BY area ORDER BY month) - 1 AS DOUBLE) AS pos, forest - (arable + cropland) AS cover, CASE WHEN swvl1 IS NULL AND swvl2 IS NULL THEN NULL ELSE (coalesce(swvl1, 0) + coalesce(swvl2, 0)) / (CASE WHEN swvl1 IS NULL THEN 0 ELSE 1 END + CASE WHEN swvl2 IS NULL THEN 0 ELSE 1 END) END AS moisture FROM {area_series}"


def _slope(c: str) -> str:
    return f"CASE WHEN count({c}) >= 2 THEN regr_slope({c}, pos) END"


@query(f"SELECT area, {_slope('t')} AS slope FROM ({_POS}) GROUP BY 1", "slope")
def linear_slope(f):
    return trends.linear_slope(f.area_series, "t", ["area"])


@query(f"SELECT area, (a + b + c) / 3 AS thermal_stress, soil_moisture_trend, ndvi_trend, mean_temperature, landcover_change FROM (SELECT area, {_slope('t')} AS a, {_slope('stl1')} AS b, {_slope('stl2')} AS c, {_slope('moisture')} AS soil_moisture_trend, {_slope('ndvi')} AS ndvi_trend, avg(t) AS mean_temperature, CASE WHEN count(*) >= 2 THEN arg_max(cover, month) - arg_min(cover, month) END AS landcover_change FROM ({_POS}) GROUP BY 1)", "thermal_stress soil_moisture_trend ndvi_trend mean_temperature landcover_change")
def kpis(f):
    return trends.kpis(f.area_series, ["area"])


@query("SELECT area, variable, first_value, last_value, min_value, max_value, last_value - first_value AS delta FROM (SELECT area, variable, arg_min(value, month) AS first_value, arg_max(value, month) AS last_value, min(value) AS min_value, max(value) AS max_value FROM (SELECT area, month, 't' AS variable, t AS value FROM {area_series} UNION ALL SELECT area, month, 'ndvi', ndvi FROM {area_series}) WHERE value IS NOT NULL GROUP BY ALL)", "first_value last_value min_value max_value delta")
def trend_summary(f):
    return trends.trend_summary(f.area_series, ["t", "ndvi"], ["area"])


# audits and months


@query("SELECT grp, variable, count(value) AS finite_count, count(*) - count(value) AS missing_count, count(*) FILTER (value = 0) AS zero_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, stddev_pop(value) AS std_value, CASE WHEN variable IN ('t2m', 'stl1') THEN '°C' WHEN variable = 'tp' THEN 'mm/month' ELSE 'native' END AS display_unit FROM {grid_long} GROUP BY grp, variable", "min_value max_value mean_value std_value")
def variable_inventory(f):
    return quality.variable_inventory(f.grid_long)


@query("SELECT source, min(month) AS first_month, max(month) AS last_month FROM {sources} GROUP BY 1")
def source_ranges(f):
    return quality.source_ranges(f.sources)


@query("SELECT max(a) AS first_month, min(b) AS last_month FROM (SELECT source, min(month) AS a, max(month) AS b FROM {sources} WHERE source IN ('temperature', 'precipitation', 'soil') GROUP BY 1)")
def common_period(f):
    return quality.common_period(quality.source_ranges(f.sources), ("temperature", "precipitation", "soil")).select(F.col("start").alias("first_month"), F.col("end").alias("last_month"))


@query("SELECT month, count(s) AS signal_count, min(s) AS signal_min, avg(s) AS signal_mean, max(s) AS signal_max, count(s) > 0 AS ok FROM (SELECT month, CASE WHEN abs(value) > 1e-8 THEN value END AS s FROM {sources}) GROUP BY 1", "signal_min signal_mean signal_max")
def month_signal(f):
    return quality.month_signal(f.sources)


@query("SELECT month, arg_min(source, priority) AS source, arg_min(cells, priority) AS cells FROM (SELECT month, source, priority, count(*) AS cells FROM {sources} WHERE abs(value) > 1e-8 GROUP BY ALL) GROUP BY 1")
def require_signal(f):
    return quality.require_signal(f.sources)


_INSIDE = "latitude BETWEEN 41 AND 42 AND longitude BETWEEN 1 AND 3"


@query(f"SELECT count(tp) AS domain_count, min(tp) AS domain_min, avg(tp) AS domain_mean, max(tp) AS domain_max, count(tp) FILTER ({_INSIDE}) AS area_count, min(tp) FILTER ({_INSIDE}) AS area_min, avg(tp) FILTER ({_INSIDE}) AS area_mean, max(tp) FILTER ({_INSIDE}) AS area_max FROM {{grid_obs}}", "domain_min domain_mean domain_max area_min area_mean area_max")
def precip_audit(f):
    return quality.precip_audit(f.grid_obs, {"min_lat": 41.0, "max_lat": 42.0, "min_lon": 1.0, "max_lon": 3.0})


def _profiled(c: str) -> str:
    return f"SELECT '{c}' AS column_name, 'double' AS type, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NULL) / count(*) * 100 AS missing_pct, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM {{grid_obs}}"


@query(" UNION ALL ".join(map(_profiled, ("t2m", "swvl2", "ndvi"))), "missing_pct mean std min q25 q50 q75 max")
def profile(f):
    return quality.profile(f.grid_obs.select("t2m", "swvl2", "ndvi"), ["t2m", "swvl2", "ndvi"])


@query("SELECT CAST(least(floor((t2m - 260) / 5), 9) AS INT) AS bucket, count(*) AS n FROM {grid_obs} WHERE t2m BETWEEN 260 AND 310 GROUP BY 1")
def histogram(f):
    return quality.histogram(f.grid_obs, "t2m", 260.0, 310.0, 10)


@query("SELECT month, lat_i, lon_i, t2m FROM {grid_obs} ORDER BY md5(concat_ws('|', '42', CAST(month AS VARCHAR), CAST(lat_i AS VARCHAR), CAST(lon_i AS VARCHAR))), month, lat_i, lon_i LIMIT 5000", "t2m")
def sample_points(f):
    return quality.sample_points(f.grid_obs.select("month", "lat_i", "lon_i", "t2m"), 5000, 42, "month", "lat_i", "lon_i")


@query()
def file_inventory(f):
    return quality.file_inventory(f.spark, f.sf_dir)


@query("SELECT count(*) AS rows, min(month) AS first_month, max(month) AS last_month, avg(CASE WHEN month = (SELECT min(month) FROM {grid_long} WHERE variable = 't2m') THEN value - 273.15 END) AS first_mean FROM {grid_long} WHERE variable = 't2m'", "first_mean")
def source_sample(f):
    return quality.source_sample(f.grid_long.where("variable = 't2m'"), "t2m")


@query("SELECT purpose, arg_max(path, struct_pack(kind := kind, latest := latest, size := size, path := path)) AS path FROM (SELECT checkpoint AS purpose, CAST(seq % 3 AS INT) AS kind, forecast_month AS latest, price AS size, path FROM {runs}) GROUP BY 1")
def best_source(f):
    return quality.best_source(f.runs.select(F.col("checkpoint").alias("purpose"), (F.col("seq") % 3).cast("int").alias("kind"), F.col("forecast_month").alias("latest"), F.col("price").alias("size"), "path"))


@query("SELECT r.source, m.month, EXISTS (SELECT 1 FROM {sources} s WHERE s.source = r.source AND s.month = m.month) AS available FROM (SELECT DISTINCT source FROM {sources}) r CROSS JOIN {months} m")
def gap_matrix(f):
    return quality.gap_matrix(f.sources, f.months)


@query("SELECT lat_i, lon_i, t2m, ndvi FROM {grid_obs} WHERE month = DATE '1998-04-01'", "t2m ndvi")
def month_cells(f):
    return quality.month_cells(f.grid_obs, "1998-04-01", ["t2m", "ndvi"])


@query("SELECT o_orderkey, CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 6 = 0) THEN 'point needs both coordinates' WHEN n = 0 THEN 'no area given' WHEN n > 1 THEN 'more than one area given' WHEN o_custkey % 4 = 0 THEN 'both dates are needed' WHEN o_custkey % 7 = 0 THEN 'dates are reversed' END AS error FROM (SELECT *, CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 6 = 0 AS INT) + CAST(o_orderkey % 5 = 0 AS INT) AS n FROM orders)")
def exactly_one_selection(f):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = f.orders.select("o_orderkey", F.when(k % 2 == 0, "x").alias("city"), F.when(k % 3 == 0, 1.0).alias("lat"), F.when(k % 6 == 0, 1.0).alias("lon"), F.when(k % 5 == 0, "b").alias("bbox"), F.when(c % 4 != 0, F.when(c % 7 == 0, "2020-03").otherwise("2020-01")).alias("start_date"), F.lit("2020-02").alias("end_date"))
    return rows.select("o_orderkey", quality.selection_error().alias("error"))


@query("SELECT source, first_month, last_month, CASE WHEN first_month < m AND m <= last_month THEN CAST(m + INTERVAL 1 MONTH AS DATE) END AS forecast_month, coalesce(first_month < m AND m + INTERVAL 1 MONTH <= last_month, false) AS compare_available FROM (SELECT source, min(month) AS first_month, max(month) AS last_month, CASE WHEN source < 'q' THEN DATE '1999-05-01' ELSE max(month) END AS m FROM {sources} GROUP BY 1)")
def forecast_month(f):
    ranges = quality.source_ranges(f.sources).withColumn("m", F.when(F.col("source") < "q", F.lit("1999-05-01").cast("date")).otherwise(F.col("last_month")))
    told = months.forecast_month(F.col("first_month"), F.col("m"), F.col("last_month"))
    return ranges.select("source", "first_month", "last_month", *(c.alias(n) for n, c in told.items()))


@query("SELECT DISTINCT r.source, m.month FROM (SELECT DISTINCT source FROM {sources}) r CROSS JOIN {months} m WHERE NOT EXISTS (SELECT 1 FROM {sources} s WHERE s.source = r.source AND s.month = m.month)")
def months_missing(f):
    frame = f.sources.select("source").distinct().join(few(f.months))
    return months.months_missing(frame, f.sources)


@query("SELECT month FROM {months} WHERE month IN (SELECT month FROM {sources} WHERE source = 'soil')")
def months_available(f):
    return months.months_available(f.months, f.sources.where("source = 'soil'"))


@query("SELECT q.source, q.last_month, l.latest, coalesce(q.last_month <= l.latest, false) AS covered FROM (SELECT s.source, m.month AS last_month FROM (SELECT DISTINCT source FROM {sources} UNION ALL SELECT 'unknown') s CROSS JOIN (SELECT CAST(month + INTERVAL 12 MONTH AS DATE) AS month FROM {months}) m) q LEFT JOIN (SELECT source, max(month) AS latest FROM {sources} GROUP BY 1) l USING (source)")
def covers_months(f):
    named = f.sources.select("source").distinct().unionByName(f.spark.range(1).select(F.lit("unknown").alias("source")))
    asked = named.crossJoin(few(f.months.select(F.add_months("month", 12).alias("last_month"))))
    return months.covers_months(f.sources, asked)


@query("SELECT source, month, previous, CAST(month + INTERVAL 1 MONTH AS DATE) AS target, month + INTERVAL 1 MONTH <= DATE '2000-06-01' AS compare_available FROM (SELECT source, month, lag(month) OVER (PARTITION BY source ORDER BY month) AS previous FROM (SELECT DISTINCT source, month FROM {sources})) WHERE previous = month - INTERVAL 1 MONTH AND month <= DATE '2000-06-01'")
def two_month_windows(f):
    rows = f.sources.select("source", "month").distinct().withColumn("last_month", F.lit("2000-06-01").cast("date"))
    return months.two_month_windows(rows, keys=("source",)).drop("last_month")


@query("SELECT c_custkey, -95 + c_custkey % 190 AS min_lat, -90 + c_custkey % 185 AS max_lat, coalesce(-95 + c_custkey % 190 BETWEEN -90 AND 90 AND -90 + c_custkey % 185 BETWEEN -90 AND 90 AND -95 + c_custkey % 190 < -90 + c_custkey % 185, false) AS valid FROM customer")
def validation_bounds(f):
    c = F.col("c_custkey")
    boxes = f.customer.select("c_custkey", (-95 + c % 190).alias("min_lat"), (-90 + c % 185).alias("max_lat"), F.lit(0).alias("min_lon"), F.lit(1).alias("max_lon"))
    return boxes.select("c_custkey", "min_lat", "max_lat", grid.bounds_valid().alias("valid"))


@query("SELECT seq, coalesce(CASE WHEN seq % 2 = 0 THEN seq % 4 = 0 END, true) AS flip_lat, coalesce(CASE WHEN seq % 2 = 0 THEN seq % 4 = 0 END, false) AS flip_lat_metrics FROM {runs}")
def manifest_defaults(f):
    from gridjobs.sources.tables import alignment_flag

    told = f.runs.withColumn("latitude_flip", F.when(F.col("seq") % 2 == 0, F.col("seq") % 4 == 0))
    return told.select("seq", alignment_flag("latitude_flip", True).alias("flip_lat"), alignment_flag("latitude_flip", False).alias("flip_lat_metrics"))


_MANIFEST = (("run_id", "run_id"), ("run.checkpoint", "checkpoint"), ("run.input.input_mode", "input_mode"), ("run.input.atmosphere", "CAST(atmosphere AS VARCHAR)"), ("paths", "concat('[\"', path, '\"]')"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, {v} AS value FROM {{runs}}" for k, v in _MANIFEST))
def flatten_manifest(f):
    nested = f.runs.select("run_id", F.struct("checkpoint", F.struct("input_mode", "atmosphere").alias("input")).alias("run"), F.array("path").alias("paths"))
    return reshape.flatten(nested)


# names and cities


@query("SELECT value, lower(regexp_replace(concat(label, '_', country), '[^a-zA-Z0-9]+', '_', 'g')) AS slug, concat('predicted_', lower(label), '_', 'mm_per_month') AS feature FROM {cities}")
def name_slugs(f):
    return f.cities.select("value", text.slugify(F.concat_ws("_", "label", "country")).alias("slug"), text.feature_label("predicted", "label", F.lit("°mm/month")).alias("feature"))


_CATALOG = "SELECT concat(trim(regexp_replace(lower(concat(label, '_', country)), '[^a-z0-9]+', '_', 'g'), '_'), '_', geonameid) AS value, label, country, country_code, lat, lon, population FROM {cities} WHERE continent = 'EUROPE'"


def catalog_of(f):
    countries = f.cities.select("country_code", "country", "continent").distinct()
    return cities.city_catalog(f.cities.drop("country", "continent", "value"), countries, "EUROPE")


@query(_CATALOG)
def city_catalog(f):
    return catalog_of(f)


@query(f"SELECT * FROM ({_CATALOG}) WHERE contains(lower(concat(label, ' ', country)), 'city 12') ORDER BY population DESC, country, label, value LIMIT 200")
def search_cities(f):
    return cities.search_cities(catalog_of(f), "city 12")


@query(f"SELECT query, label, country, min_lat, max_lat FROM (SELECT q.query, c.label, c.country, c.lat - 0.5 AS min_lat, c.lat + 0.5 AS max_lat, row_number() OVER (PARTITION BY q.query ORDER BY population DESC, country, label, value) AS n FROM (SELECT DISTINCT upper(label) AS query FROM {{cities}}) q JOIN ({_CATALOG}) c ON lower(q.query) = lower(c.label)) WHERE n = 1")
def resolve_city(f):
    asked = f.cities.select(F.upper("label").alias("query")).distinct()
    return cities.resolve_city(asked, catalog_of(f), 0.5).select("query", "label", "country", "min_lat", "max_lat")


from gridjobs.plans import stored  # noqa: E402,F401  registers the queries of readers and writers
