"""Readers and writers of the library's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridjobs.functions.grid import crop_domain, prepare_spatial
from gridjobs.functions.tables import few
from gridjobs.functions.values import decimal_comma, number

OCCURRENCES = ("Species", "Latitude", "Longitude", "Timestamp")
AREAS = "label string, min_lat double, max_lat double, min_lon double, max_lon double"
CASES = "city string, start string, `end` string"
BOUNDS = ("min_lat", "max_lat", "min_lon", "max_lon")
CITIES = "value string, label string, country string, countryCode string, lat double, lon double, population long"


def read_occurrences(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, bounds: dict | None = None) -> DataFrame:
    """Four columns; the time range [start, end + 1 month) and the box reach the Parquet scan."""
    rows = spark.read.parquet(path).select(*OCCURRENCES)
    if start:
        rows = rows.where((F.col("Timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("Timestamp") < F.add_months(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    if bounds:
        rows = rows.where(F.col("Latitude").between(bounds["min_lat"], bounds["max_lat"]) & F.col("Longitude").between(bounds["min_lon"], bounds["max_lon"]))
    return rows.toDF("species", "latitude", "longitude", "ts")


def read_spatial_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose coordinate columns are found by name; all other columns stay text."""
    return prepare_spatial(spark.read.csv(path, header=True))


def read_grid_long(spark: SparkSession, path: str, variables: list[str], start: str | None = None, end: str | None = None, model: bool | None = None) -> DataFrame:
    """Chosen variables and months of a long grid table partitioned by variable; model crops it to the
    model domain (True) or the wider one (False)."""
    rows = spark.read.parquet(path).where(F.col("variable").isin(*variables))
    rows = rows if model is None else crop_domain(rows, model)
    return rows.where(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) if start else rows


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tile_seq", "tile", "latitude", "longitude", "value", "nodata")


def _read_json(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a JSON list; a row without one of the required keys is an error, as nothing may vanish."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    lacking = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required))
    return rows.where(F.when(lacking == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{path}: a row lacks "), lacking)).cast("boolean")))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, AREAS, ["label", "min_lat", "max_lat", "min_lon", "max_lon"])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases; each must have all three keys."""
    return _read_json(spark, path, CASES, ["city", "start", "end"])


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, CITIES, ["value"]).withColumnRenamed("countryCode", "country_code")


def read_forecast_layers(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Layers of some months as (month, variable, column_name, lat_i, lon_i, value).

    Each layer (month and variable) has its own predicted column: of several in the table's schema the
    first that has a value in the layer. One aggregate over (month, variable) finds them.
    """
    rows = prepare_spatial(spark.read.option("mergeSchema", "true").parquet(path).where(F.col("month").isin(*months)))
    names = [c for c in rows.columns if c.startswith("predicted_")]
    if not names:
        raise KeyError("no predicted_ column")
    own = rows.groupBy("month", "variable").agg(F.coalesce(*(F.when(F.count(F.col(f"`{c}`")) > 0, F.lit(c)) for c in names), F.lit(names[0])).alias("column_name"))
    value = F.coalesce(*(F.when(F.col("column_name") == c, number(F.col(f"`{c}`"))) for c in names))
    return rows.join(few(own), ["month", "variable"]).select("month", "variable", "column_name", "lat_i", "lon_i", value.alias("value"))


def alignment_flag(c, default: bool) -> Column:
    """A manifest's orientation flag, or what its reader assumes where it is missing."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


#: What is read of a manifest, by its path in the JSON and type; the rest stays in column manifest.
MANIFEST_FIELDS = {
    "run": "string", "run_id": "string", "mode": "string", "label": "string", "selection_mode": "string", "checkpoint_kind": "string", "input_mode": "string", "device": "string",
    "input_months": "array<string>", "forecast_month": "string", "forecast_months": "array<string>", "bounds": "struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>", "group_source_status": "map<string,string>",
}


def read_run_manifests(spark: SparkSession, path: str, skip: tuple[str, ...] = ("published", "reports"), fields: dict[str, str] = MANIFEST_FIELDS) -> DataFrame:
    """All run manifests below a folder, without those of published and report folders.

    Files are read once, as VARIANT, with a fixed projection: no schema is inferred, so manifests may
    drift, and what has another type than asked, or is missing, is null. A file that is no JSON has null
    in all columns but path. latitude_flip and longitude_flip are the orientation a manifest tells; one
    without the block spatial_alignment is read as turned north to south, one with the block but not the
    flag as missing.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.try_parse_json("value").alias("manifest"), F.input_file_name().alias("path"))
    for part in skip:
        rows = rows.where(~F.contains("path", F.lit(f"/{part}/")))
    told = lambda at, kind: F.try_variant_get("manifest", f"$.{at}", kind)
    block = told("spatial_alignment", "variant")
    some, known = block.isNotNull() & ~F.is_variant_null(block), F.col("manifest").isNotNull()
    flags = {}
    for name, at, default in (("latitude_flip", "prediction_latitude_flip_applied", True), ("longitude_flip", "prediction_longitude_flip_applied", False)):
        flags[name] = F.when(some, told(f"spatial_alignment.{at}", "boolean")).when(known, F.lit(default))
    return rows.withColumns({**{n: told(n, kind) for n, kind in fields.items()}, **flags})


def read_area_month(spark: SparkSession, path: str) -> DataFrame:
    """Area months from CSV: counts by way of numbers, empty text as missing."""
    rows = spark.read.csv(path, header=True)
    counts = ("valid_cell_count", "cell_count_land", "cells_with_species_records", "species_count_observed_area")
    typed = {c: number(c) for c in rows.columns if c not in ("month", "precipitation_unit")}
    typed |= {c: number(c).cast("long") for c in counts if c in rows.columns}
    return rows.withColumns({**typed, "month": F.col("month").try_cast("date")})


def write_cells(df: DataFrame, path: str) -> None:
    df.write.partitionBy("month").mode("overwrite").parquet(path)


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches by month; a rerun replaces the months that it has and leaves the others."""
    sketches.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_sketches(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored sketches, of a range of months if one is given; other months' files are not opened."""
    rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("date"))
    return rows.where(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) if start else rows


def write_csv(df: DataFrame, path: str, excel: bool = False, comma: bool = False) -> None:
    """CSV; excel parts fields by semicolons, comma also writes decimal commas."""
    if comma:
        df = df.withColumns({f.name: decimal_comma(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    df.write.mode("overwrite").csv(path, header=True, sep=";" if excel or comma else ",")


#: What a summary says of its columns.
SEMANTICS = {
    "species_semantics_area": "species_count_observed_area = number of species observed in the selected area in a month",
    "species_semantics_cells": "species_count_observed_cell = number of species observed in a cell in a month",
    "species_note": "a missing number of species means no records in that month",
}


#: How the precipitation columns come from a source's variable.
PRECIPITATION = {
    "avg_tprate": "mean rate in kg m-2 s-1 times 86400 gives mm a day, times the days of the month mm a month",
    "tp": "metres times 1000 give mm a month, divided by the days of the month mm a day",
}


def bounds_to_json(bounds: dict[str, float]) -> str:
    """A box as JSON text, its sides in a fixed order."""
    return json.dumps({k: float(bounds[k]) for k in BOUNDS})


def bounds_from_json(c) -> Column:
    """A box of JSON text as a struct of four doubles; missing if a side is."""
    box = F.from_json(c, ", ".join(f"{k} double" for k in BOUNDS))
    return F.when(F.forall(F.array(*(box[k] for k in BOUNDS)), lambda x: x.isNotNull()), box)


def write_summary_json(df: DataFrame, path: str, label: str, mode: str, bounds: dict[str, float] | None = None, sources: dict[str, str] | None = None, selection: str | None = None, cell_rows: int | None = None, requested: tuple[str, str] | None = None, precipitation: str | None = None) -> None:
    """One row about an area-month table: period and counts, box, sources and what its columns mean.

    requested: the months asked for, which may have no rows; precipitation: from which variable its
    columns come (avg_tprate or tp), told with how they were converted.
    """
    species = F.count("species_count_observed_area") if "species_count_observed_area" in df.columns else F.lit(None).cast("long")
    cells = F.max("cell_count_land") if "cell_count_land" in df.columns else F.lit(None).cast("long")
    box = F.struct(*(F.lit(float(bounds[k])).alias(k) for k in BOUNDS)) if bounds else F.lit(None).cast("string")
    row = df.agg(
        F.lit(label).alias("label"), F.lit(mode).alias("mode"), *(F.lit(requested[k] if requested else None).cast("string").alias(n) for k, n in enumerate(("requested_start", "requested_end"))), F.lit(PRECIPITATION.get(precipitation)).cast("string").alias("precipitation_conversion"), F.lit(selection).cast("string").alias("selection_mode"), box.alias("bounds"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.countDistinct("month").alias("months"), cells.alias("cell_count_land"), F.lit(cell_rows).cast("long").alias("cell_rows"), species.alias("species_months_with_records"),
        *(F.lit(v).alias(f"{k}_source") for k, v in (sources or {}).items()), *(F.lit(v).alias(k) for k, v in SEMANTICS.items()))
    row.write.mode("overwrite").json(path)


def publish_forecast_month(df: DataFrame, path: str, features: list[str], source_run: str | None = None, input_months: list[str] | None = None) -> DataFrame:
    """Write each month to its own folder, replacing that month only, and then the months' manifest rows to
    the table <path>_manifest; return these rows as they are stored.

    A row tells the month, its step and the number of steps of this publication, its rows, its features
    and those of the wanted list that it lacks, the months that the run read, and the run. df is evaluated
    once: the manifest is made from what was written. Months of one publication are few, as a rollout has
    a step for each; their rows are numbered after the aggregation.
    """
    spark, batch = df.sparkSession, uuid.uuid4().hex
    df.withColumn("_batch", F.lit(batch)).write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    written = spark.read.parquet(path).where(F.col("_batch") == batch)
    have = F.collect_set("variable")
    rows = written.groupBy(F.col("month").cast(df.schema["month"].dataType).alias("month")).agg(F.count("*").alias("rows"), F.sort_array(have).alias("features"), F.sort_array(F.array_except(F.array(*map(F.lit, features)), have)).alias("missing_features"))
    steps = rows.agg(F.sort_array(F.collect_list("month")).alias("m"))
    months = F.array(*map(F.lit, input_months)) if input_months else F.array().cast("array<string>")
    told = rows.crossJoin(F.broadcast(steps)).withColumns({"rollout_step_index": F.array_position("m", F.col("month")).cast("int"), "rollout_steps_total": F.size("m"), "input_months": months, "source_run_dir": F.lit(source_run).cast("string")})
    told.drop("m").withColumn("_batch", F.lit(batch)).write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}_manifest")
    stored = spark.read.parquet(f"{path}_manifest").where(F.col("_batch") == batch).drop("_batch")
    return stored.withColumn("month", F.col("month").cast(df.schema["month"].dataType))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """All published months."""
    return spark.read.parquet(path).drop("_batch")
