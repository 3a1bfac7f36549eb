"""Registered queries of readers and writers: tables derived from the given ones are written in the layout
that a reader expects, and read back by it. What they write stays in the shared folder until the result is
stored, as it is read from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridjobs.plans.catalog import BOX, query
from gridjobs.sources import tables
from gridjobs.sources.places import new_place


def _in_box(lat: str, lon: str) -> str:
    return f"{lat} BETWEEN {BOX['min_lat']} AND {BOX['max_lat']} AND {lon} BETWEEN {BOX['min_lon']} AND {BOX['max_lon']}"


@query(f"SELECT species, latitude, longitude, CAST(ts AS DATE) AS day FROM {{occ}} WHERE ts >= DATE '1994-03-01' AND ts < DATE '1997-07-01' AND {_in_box('latitude', 'longitude')}")
def read_occurrences(f):
    path = new_place(f.spark, "occurrences")
    ts = F.col("ts").cast("timestamp_ntz").alias("Timestamp")
    f.occ.select(F.col("species").alias("Species"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), ts, F.lit("gps").alias("Origin")).write.parquet(path)
    got = tables.read_occurrences(f.spark, path, "1994-03-01", "1997-06-01", BOX)
    return got.select("species", "latitude", "longitude", F.to_date("ts").alias("day"))


@query("SELECT value AS place, CAST(round_even((lat + population % 100 / CAST(1000 AS DOUBLE)) * 4, 0) AS INT) AS lat_i, CAST(round_even(lon * 4, 0) AS INT) AS lon_i, CAST(population AS VARCHAR) AS people FROM {cities} WHERE geonameid % 13 <> 0 AND geonameid % 17 <> 0")
def read_spatial_table(f):
    """Coordinates under other names, as text, some of them no numbers or missing: those rows go."""
    path = new_place(f.spark, "places")
    lat = F.when(F.expr("geonameid % 13 = 0"), "n/a").when(F.expr("geonameid % 17 = 0"), None).otherwise(F.expr("CAST(lat + population % 100 / CAST(1000 AS DOUBLE) AS STRING)"))
    tables.write_csv(f.cities.select(F.col("value").alias("place"), lat.alias("LAT"), F.col("lon").alias("Long"), F.col("population").alias("people")), path)
    return tables.read_spatial_table(f.spark, path).select("place", "lat_i", "lon_i", "people")


@query("SELECT month, lat_i, lon_i, variable, value FROM {grid_long} WHERE variable IN ('t2m', 'swvl1') AND month BETWEEN DATE '1993-02-01' AND DATE '1997-11-01'", "value")
def read_grid_long(f):
    path = new_place(f.spark, "grid")
    f.grid_long.write.partitionBy("variable").parquet(path)
    return tables.read_grid_long(f.spark, path, ["t2m", "swvl1"], "1993-02-01", "1997-11-01").select("month", "lat_i", "lon_i", "variable", "value")


@query("SELECT tile_seq, concat('tile_', CAST(tile_seq AS VARCHAR)) AS tile, latitude, longitude, CAST(value AS DOUBLE) AS value, nodata FROM {pixels}", "latitude longitude value")
def read_pixels(f):
    path = new_place(f.spark, "pixels")
    f.pixels.withColumn("tile", F.concat(F.lit("tile_"), F.col("tile_seq").cast("string"))).write.parquet(path)
    return tables.read_pixels(f.spark, path).withColumn("value", F.col("value").cast("double"))


#: Entries of one stored list.
LISTED = 2000


def _lists(f, rows, number, name: str) -> str:
    """Store rows as JSON lists of at most LISTED entries, a file each, by ranges of a whole number from 0."""
    path = new_place(f.spark, name)
    entry = F.to_json(F.struct(*rows.columns))
    lists = rows.select(F.floor(number / LISTED).alias("part"), entry.alias("e")).groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ",\n"), F.lit("]")).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(path)
    return path


@query("SELECT area_label AS label, min_lat, max_lat, min_lon, max_lon FROM {areas}", "min_lat max_lat min_lon max_lon")
def read_areas(f):
    path = _lists(f, f.areas.select(F.col("area_label").alias("label"), *tables.BOUNDS, "seq"), F.col("seq"), "areas")
    return tables.read_areas(f.spark, path).drop("part")


@query("SELECT concat('city_', CAST(o_custkey % 15 AS VARCHAR)) AS city, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CAST(o_orderkey AS VARCHAR) AS end_key FROM orders")
def read_cases(f):
    cases = f.orders.select(F.concat(F.lit("city_"), (F.col("o_custkey") % 15).cast("string")).alias("city"), F.to_date("o_orderdate").cast("string").alias("start"), F.col("o_orderkey").cast("string").alias("end"), "o_orderkey")
    return tables.read_cases(f.spark, _lists(f, cases, F.col("o_orderkey"), "cases")).drop("part").withColumnRenamed("end", "end_key")


@query("SELECT value, label, country, country_code, lat, lon, population FROM {cities}", "lat lon")
def read_cities(f):
    path = _lists(f, f.cities.select("value", "label", "country", F.col("country_code").alias("countryCode"), "lat", "lon", "population", "geonameid"), F.col("geonameid"), "cities")
    return tables.read_cities(f.spark, path).drop("part")


_PREDICTED = ("stl1", "swvl1", "t2m", "tp")


@query("SELECT CAST(month AS VARCHAR) AS month, variable, concat('predicted_', CASE WHEN count(value) OVER (PARTITION BY month, variable) = 0 THEN 'stl1' ELSE variable END) AS column_name, lat_i, lon_i, value FROM {grid_long}", "value")
def read_forecast_layers(f):
    """A column to each variable in the table's schema; every layer has values in its own alone."""
    path = new_place(f.spark, "layers")
    own = [F.when(F.col("variable") == v, F.col("value")).alias(f"predicted_{v}") for v in _PREDICTED]
    f.grid_long.select(F.col("month").cast("string").alias("month"), "variable", "latitude", "longitude", *own).write.parquet(path)
    every = [str(r["month"]) for r in f.months.collect()]  # a dimension: the months of a period
    return tables.read_forecast_layers(f.spark, path, every)


_SERIES = "SELECT month, min(t2m) AS temperature_mean_area_c, max(ndvi) AS ndvi_mean_area, count(*) AS cell_count_land, count(t2m) AS valid_cell_count, 'mm/month' AS precipitation_unit FROM {grid_obs} GROUP BY 1"


def _series(f):
    return f.grid_obs.groupBy("month").agg(F.min("t2m").alias("temperature_mean_area_c"), F.max("ndvi").alias("ndvi_mean_area"), F.count("*").alias("cell_count_land"), F.count("t2m").alias("valid_cell_count"), F.lit("mm/month").alias("precipitation_unit"))


@query(_SERIES, "temperature_mean_area_c ndvi_mean_area")
def read_area_month(f):
    path = new_place(f.spark, "area-months")
    tables.write_csv(_series(f), path)
    return tables.read_area_month(f.spark, path)


@query("SELECT CAST(month AS VARCHAR) AS month, replace(CAST(swvl AS VARCHAR), '.', ',') AS swvl, cells FROM (SELECT month, floor(max(swvl1) * 1000) + CAST(0.5 AS DOUBLE) AS swvl, CAST(count(*) AS VARCHAR) AS cells FROM {grid_obs} GROUP BY 1)")
def write_csv(f):
    """The form with decimal commas, read as plain text by its separators."""
    path = new_place(f.spark, "commas")
    tables.write_csv(f.grid_obs.groupBy("month").agg((F.floor(F.max("swvl1") * 1000) + F.lit(0.5)).alias("swvl"), F.count("*").alias("cells")), path, comma=True)
    return f.spark.read.csv(path, header=True, sep=";")


@query("SELECT month, lat_i, lon_i, t2m, tp FROM {grid_obs}", "t2m tp")
def write_cells(f):
    path = new_place(f.spark, "cells")
    tables.write_cells(f.grid_obs.select("month", "lat_i", "lon_i", "t2m", "tp"), path)
    return f.spark.read.parquet(path)


@query(f"SELECT 'All cells' AS label, 'city' AS mode, '1992-01-01' AS requested_start, '1999-12-01' AS requested_end, CAST(min(month) AS VARCHAR) AS first_month, CAST(max(month) AS VARCHAR) AS last_month, count(DISTINCT month) AS months, max(cell_count_land) AS cell_count_land, {BOX['min_lat']} AS south, {BOX['max_lon']} AS east FROM ({_SERIES})", "south east")
def write_summary_json(f):
    path = new_place(f.spark, "summary")
    tables.write_summary_json(_series(f), path, "All cells", "city", BOX, {"temperature": "t.nc"}, requested=("1992-01-01", "1999-12-01"), precipitation="tp")
    told = f.spark.read.json(path)
    return told.select("label", "mode", "requested_start", "requested_end", "first_month", "last_month", "months", "cell_count_land", F.col("bounds.min_lat").alias("south"), F.col("bounds.max_lon").alias("east"))


@query("""SELECT month, count(*) AS rows, string_agg(DISTINCT variable, ',' ORDER BY variable) AS features, 'q' AS missing_features, CAST(row_number() OVER (ORDER BY month) AS INT) AS rollout_step_index, CAST(count(*) OVER () AS INT) AS rollout_steps_total,
  '1991-11,1991-12' AS input_months, 'run_7' AS source_run_dir FROM {grid_long} GROUP BY month""")
def publish_forecast_month(f):
    path = new_place(f.spark, "published")
    told = tables.publish_forecast_month(f.grid_long.select("month", "variable", "lat_i", "lon_i", "value"), path, ["t2m", "tp", "swvl1", "stl1", "q"], "run_7", ["1991-11", "1991-12"])
    return told.withColumns({c: F.array_join(c, ",") for c in ("features", "missing_features", "input_months")})


@query("SELECT month, variable, lat_i, lon_i, value FROM {grid_long}", "value")
def read_published(f):
    """Published twice: what a rerun replaces is not there twice."""
    path = new_place(f.spark, "published")
    rows = f.grid_long.select("month", "variable", "lat_i", "lon_i", "value")
    tables.publish_forecast_month(rows.withColumn("value", F.lit(-1.0)), path, ["t2m"])
    tables.publish_forecast_month(rows, path, ["t2m"])
    return tables.read_published(f.spark, path)


@query("SELECT concat('run_', CAST(forecast_month AS VARCHAR)) AS run_id, CAST(forecast_month AS VARCHAR) AS forecast_month, CAST(count(*) AS VARCHAR) AS label, string_agg(DISTINCT checkpoint, ',' ORDER BY checkpoint) AS input_months, CAST(min(seq) AS DOUBLE) AS south, min(seq) % 3 <> 1 AS latitude_flip, CASE WHEN min(seq) % 3 <> 1 THEN min(seq) % 3 = 2 END AS longitude_flip FROM {runs} GROUP BY forecast_month", "south")
def read_run_manifests(f):
    """A manifest to a month: a third lacks the block of orientations, a third lacks its flags for
    longitude, and the type of one field drifts."""
    path = new_place(f.spark, "manifests")
    per = f.runs.groupBy("forecast_month").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("checkpoint")).alias("input_months"), F.min("seq").alias("first"))
    month, first = F.col("forecast_month").cast("string"), F.col("first")
    block = F.when(first % 3 == 1, F.struct(F.lit(False).alias("prediction_latitude_flip_applied"), F.lit(None).cast("boolean").alias("prediction_longitude_flip_applied")))
    block = block.when(first % 3 == 2, F.struct(F.lit(True).alias("prediction_latitude_flip_applied"), F.lit(True).alias("prediction_longitude_flip_applied")))
    device = F.when(first % 2 == 0, F.lit('"cpu"')).otherwise(F.lit('{"kind": "cpu", "threads": 4}'))
    told = F.to_json(F.struct(F.concat(F.lit("run_"), month).alias("run_id"), month.alias("forecast_month"), F.col("n").cast("string").alias("label"), "input_months", F.struct(*(first.cast("double").alias(k) for k in tables.BOUNDS)).alias("bounds"), block.alias("spatial_alignment")))
    text = F.concat(F.expr("left(told, length(told) - 1)"), F.lit(', "device": '), device, F.lit("}"))
    per.withColumn("told", told).select("forecast_month", text.alias("value")).repartition("forecast_month").write.partitionBy("forecast_month").text(path)
    got = tables.read_run_manifests(f.spark, path)
    return got.select("run_id", "forecast_month", "label", F.array_join("input_months", ",").alias("input_months"), F.col("bounds.min_lat").alias("south"), "latitude_flip", "longitude_flip")


@query("SELECT area_label, CASE WHEN seq % 7 <> 0 THEN min_lat END AS south, CASE WHEN seq % 7 <> 0 THEN max_lat END AS north, CASE WHEN seq % 7 <> 0 THEN min_lon END AS west, CASE WHEN seq % 7 <> 0 THEN max_lon END AS east FROM {areas}", "south north west east")
def bounds_from_json(f):
    """Boxes as JSON text; one that lacks a side is missing."""
    side = lambda k: F.when((F.col("seq") % 7 != 0) | F.lit(k != "max_lon"), F.col(k)).alias(k)
    told = f.areas.select("area_label", tables.bounds_from_json(F.to_json(F.struct(*map(side, tables.BOUNDS)))).alias("b"))
    return told.select("area_label", *(F.col(f"b.{k}").alias(n) for k, n in zip(tables.BOUNDS, ("south", "north", "west", "east"))))
