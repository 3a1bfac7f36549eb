"""Forecast verification: runs, pairs, grades, dashboards, areas, validation, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridjobs.functions.grid import flip, flip_by
from gridjobs.functions.tables import few
from gridjobs.functions.values import col, pct_error, pct_error_kelvin
from gridjobs.operators.quantiles import median_of_group
from gridjobs.operators.summed import area_metrics

#: States that count as ready, and the features of reports.
READY_STATES = ("ready_high", "usable_medium", "diagnostic_medium", "diagnostic_promising", "context_spatially_consistent", "diagnostic_spatially_consistent")
CORE = (("climate", "t2m"), ("climate", "tp"), ("climate", "d2m"), ("vegetation", "ndvi"), ("forest", "forest"), ("agriculture", "agriculture"))
#: Fixed values: (group, variable, domain, use, interpretation, role).
METADATA = (
    ("climate", "t2m", "temperature_stress", "core_forecast_indicator", "Damage/restoration climate pressure", "primary forecast indicator"),
    ("climate", "tp", "precipitation_water_stress", "secondary_diagnostic", "Hydrological stress and drought/wetness context", "supporting forecast indicator"),
    ("vegetation", "NDVI", "vegetation_condition", "promising_diagnostic", "Restoration greenness / vegetation condition", "ecological support indicator"),
    ("forest", "Forest", "forest_context", "context_layer", "Forest damage/restoration context", "contextual indicator"),
    ("agriculture", "Agriculture", "agriculture_pressure", "context_layer", "Anthropic land pressure", "contextual pressure indicator"),
    ("agriculture", "Cropland", "cropland_pressure", "context_layer", "Anthropic land pressure", "contextual pressure indicator"),
    ("agriculture", "Arable", "arable_pressure", "context_layer", "Anthropic land pressure", "contextual pressure indicator"),
    ("atmospheric", "q", "atmospheric_moisture", "diagnostic", "Atmospheric moisture support", "diagnostic climate variable"),
    ("edaphic", "swvl1", "soil_water_stress", "diagnostic", "Shallow soil moisture support", "ecohydrological support indicator"),
    ("edaphic", "swvl2", "soil_water_stress", "diagnostic", "Deeper soil moisture support", "ecohydrological support indicator"),
    ("edaphic", "stl1", "soil_temperature", "diagnostic", "Shallow soil temperature support", "soil temperature indicator"),
    ("edaphic", "stl2", "soil_temperature", "diagnostic", "Deeper soil temperature support", "soil temperature indicator"),
    ("climate", "avg_snlwrf", "surface_radiation_balance", "diagnostic", "Surface net long-wave radiation support", "radiation diagnostic variable"),
    ("land", "Land", "land_mask_context", "technical_context", "Mask/support variable", "technical support variable"),
    ("redlist", "RLI", "redlist_context", "context_layer", "Conservation-risk context", "conservation context indicator"),
    ("misc", "avg_slhtf", "energy_balance_context", "diagnostic", "Surface latent heat flux support", "diagnostic support variable"),
    ("misc", "avg_pevr", "evaporation_context", "diagnostic", "Potential evaporation rate support", "diagnostic support variable"),
)
#: What holds for other variables of a group, and for all others.
GROUP_METADATA = (
    ("species", "species_distribution_proxy", "exploratory_species", "Native species distribution channel", "experimental biodiversity variable"),
    ("species_proxy", "biodiversity_proxy", "exploratory", "Native species proxy, not final richness", "biodiversity proxy"),
)
DEFAULT_METADATA = ("native_model_variable", "exploratory_native", "Use only after variable-specific validation", "exploratory variable")
TOLD = ("domain", "use", "interpretation", "role")


def select_runs(runs: DataFrame, checkpoint: str | None = None, year: int | None = None) -> DataFrame:
    """One run per forecast month: names that do not end in ' 4' first, then by path."""
    some = runs
    if checkpoint:
        some = some.where(F.col("checkpoint") == checkpoint)
    if year:
        some = some.where(F.year("forecast_month") == year)
    first = F.row_number().over(Window.partitionBy("forecast_month").orderBy(F.endswith("run_id", F.lit(" 4")), "path"))
    return some.withColumn("_n", first).where("_n = 1").drop("_n")


def pair_maps(predicted: DataFrame, observed: DataFrame, keys: list[str], flip_lat: bool = False, flip_lon: bool = False, size=(160, 280), keep_unmatched: bool = False) -> DataFrame:
    """Predicted beside observed values by cell, the prediction turned first if its run says so."""
    turned = flip(predicted, flip_lat, flip_lon, *size)
    cell = [*keys, "lat_index", "lon_index"]
    return turned.select(*cell, "predicted").join(observed.select(*cell, "observed"), cell, "left" if keep_unmatched else "inner")


def pair_runs(predicted: DataFrame, observed: DataFrame, runs: DataFrame, keys: list[str], export: bool = False, size=(160, 280), keep_unmatched: bool = False) -> DataFrame:
    """pair_maps of many runs in one job, each turned as its own manifest says.

    runs: run_id, latitude_flip, longitude_flip (null where a manifest says nothing). Metrics then take
    no turn; exports assume that rows are turned and columns are not. A run without a row in runs counts
    as one whose manifest says nothing. One prediction and its flags meet by an equi-join on run_id.
    """
    flags = few(runs.select("run_id", *(F.coalesce(c, F.lit(d)).alias(f"_{c}") for c, d in (("latitude_flip", export), ("longitude_flip", False)))))
    told = predicted.join(flags, "run_id", "left").withColumns({"_latitude_flip": F.coalesce("_latitude_flip", F.lit(export)), "_longitude_flip": F.coalesce("_longitude_flip", F.lit(False))})
    turned = flip_by(told, "_latitude_flip", "_longitude_flip", *size)
    cell = ["run_id", *keys, "lat_index", "lon_index"]
    return turned.select(*cell, "predicted").join(observed.select(*cell, "observed"), cell, "left" if keep_unmatched else "inner")


def store_pairing(spark: SparkSession, predicted: DataFrame, observed: DataFrame, runs: DataFrame, names: tuple[str, str], keys: list[str], buckets: int, paths: tuple[str, str] | None = None, export: bool = False, size=(160, 280)) -> None:
    """Store predictions, turned as their manifests say, and observations as bucketed tables of one layout.

    Both are dealt by run, keys and cell to the same buckets, one sorted file each, so pair_stored joins
    them without moving a row, as often as it is asked. names: the two tables; paths: where they lie, if
    not in the warehouse.
    """
    flags = few(runs.select("run_id", *(F.coalesce(c, F.lit(d)).alias(f"_{c}") for c, d in (("latitude_flip", export), ("longitude_flip", False)))))
    told = predicted.join(flags, "run_id", "left").withColumns({"_latitude_flip": F.coalesce("_latitude_flip", F.lit(export)), "_longitude_flip": F.coalesce("_longitude_flip", F.lit(False))})
    cell = ["run_id", *keys, "lat_index", "lon_index"]
    turned = flip_by(told, "_latitude_flip", "_longitude_flip", *size).select(*cell, "predicted")
    for k, (rows, name) in enumerate(zip((turned, observed.select(*cell, "observed")), names)):
        writer = rows.repartition(buckets, *cell).write.mode("overwrite").format("parquet").bucketBy(buckets, *cell).sortBy(*cell)
        (writer.option("path", paths[k]) if paths else writer).saveAsTable(name)


def pair_stored(spark: SparkSession, names: tuple[str, str], keys: list[str], keep_unmatched: bool = False) -> DataFrame:
    """pair_runs from tables that store_pairing wrote; the join has no exchange below it."""
    cell = ["run_id", *keys, "lat_index", "lon_index"]
    # merge, as a broadcast of either side would move it
    return spark.table(names[0]).hint("merge").join(spark.table(names[1]), cell, "left" if keep_unmatched else "inner")


def reliability(group="grp", variable="variable", mae="mae", corr="correlation", rel="rmae_pct") -> Column:
    """Grades in the words of the reports; comparisons with a missing metric fail."""
    g, v, m, r, e = map(col, (group, variable, mae, corr, rel))
    at = lambda x, y: (g == x) & (v == y)
    t2m = F.when((m <= 2.0) & (r >= 0.9), "alta").when((m <= 3.0) & (r >= 0.75), "buona").when((m <= 5.0) & (r >= 0.5), "media").otherwise("bassa")
    tp = F.when((r >= 0.7) & (e <= 50), "media-alta").when((r >= 0.4) & (e <= 100), "media").otherwise("bassa")
    proxy = F.when((r >= 0.7) & (e <= 50), "promettente").when(r >= 0.4, "da verificare").otherwise("debole")
    other = F.when((r >= 0.8) & (e <= 25), "buona").when(r >= 0.5, "media").otherwise("bassa/diagnostica")
    return F.when(at("climate", "t2m"), t2m).when(at("climate", "tp"), tp).when(g == "species_proxy", proxy).otherwise(other)


def readiness(group="grp", variable="variable", mae="mae", bias="bias", corr="correlation", rel="rmae_pct") -> Column:
    g, v, m, r, e = map(col, (group, variable, mae, corr, rel))
    b = F.abs(col(bias))
    at = lambda x, y: (g == x) & (v == y)
    over = lambda t, yes, no: F.when(r >= t, yes).otherwise(no)
    t2m = F.when((m <= 2.0) & (b <= 1.0) & (r >= 0.90), "ready_high").when((m <= 3.5) & (b <= 3.0) & (r >= 0.75), "usable_medium").otherwise("needs_calibration")
    tp = F.when((r >= 0.60) & (e <= 100) & (b <= 2.0), "diagnostic_medium").otherwise("weak_precipitation")
    return (
        F.when(at("climate", "t2m"), t2m).when(at("climate", "tp"), tp)
        .when(g == "species_proxy", "exploratory_not_final").when(g == "species", "exploratory_species_map")
        .when(at("vegetation", "NDVI"), over(0.70, "diagnostic_promising", "diagnostic_uncertain"))
        .when(g.isin("forest", "agriculture", "redlist"), over(0.70, "context_spatially_consistent", "context_uncertain"))
        .when(g.isin("edaphic", "misc", "atmospheric", "climate"), over(0.75, "diagnostic_spatially_consistent", "diagnostic_uncertain"))
        .otherwise("native_metric_only")
    )


def attach_metadata(metrics: DataFrame, group: str = "grp") -> DataFrame:
    """domain, use, interpretation and role: of the variable, else of its group, else the default."""
    spark = metrics.sparkSession
    one = spark.createDataFrame(METADATA, f"{group} string, variable string, " + ", ".join(f"_v_{c} string" for c in TOLD))
    two = spark.createDataFrame(GROUP_METADATA, f"{group} string, " + ", ".join(f"_g_{c} string" for c in TOLD))
    rows = metrics.join(F.broadcast(one), [group, "variable"], "left").join(F.broadcast(two), group, "left")
    rows = rows.withColumns({c: F.coalesce(f"_v_{c}", f"_g_{c}", F.lit(d)) for c, d in zip(TOLD, DEFAULT_METADATA)})
    return rows.drop(*(f"_{k}_{c}" for k in "vg" for c in TOLD))


#: Features of curated reports (group, variable).
CURATED = (("climate", "t2m"), ("climate", "tp"), ("vegetation", "NDVI"), ("edaphic", "swvl1"), ("edaphic", "swvl2"), ("atmospheric", "q"), ("edaphic", "stl1"), ("edaphic", "stl2"), ("agriculture", "Cropland"), ("agriculture", "Arable"), ("forest", "Forest"), ("climate", "avg_snlwrf"))


def curated_filter(df: DataFrame, features=CURATED) -> DataFrame:
    """Rows of the listed features."""
    listed = df.sparkSession.createDataFrame(list(features), "grp string, variable string")
    return df.join(F.broadcast(listed), ["grp", "variable"], "left_semi")


#: Report sheets as row tests.
SHEETS = {
    "climate_other": lambda: (F.col("grp") == "climate") & ~F.col("variable").isin("t2m", "tp"),
    "soil_and_land": lambda: F.col("grp").isin("edaphic", "land"),
    "context": lambda: F.col("grp").isin("misc", "redlist", "forest", "agriculture"),
    "species": lambda: F.col("grp").isin("species", "species_proxy"),
}


def sheet_of() -> Column:
    out = F.lit(None).cast("string")
    for name, test in SHEETS.items():
        out = F.when(test(), name).otherwise(out)
    return out


def shared_variables(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("grp", "variable").distinct().join(two.select("grp", "variable").distinct(), ["grp", "variable"])


def missing_features(rows: DataFrame, features) -> DataFrame:
    """Listed features without a row in a run."""
    listed = rows.sparkSession.createDataFrame(list(features), "grp string, variable string")
    frame = rows.select("run_id").distinct().crossJoin(few(listed))
    return frame.join(rows.select("run_id", "grp", "variable").distinct(), ["run_id", "grp", "variable"], "left_anti")


def core_filter() -> Column:
    pair = F.concat_ws("|", "grp", F.lower("variable"))
    return pair.isin(*("|".join(x) for x in CORE)) | (F.col("grp") == "species_proxy")


def dashboard(metrics: DataFrame) -> DataFrame:
    """Per feature, missing keys kept: means over runs, distinct and ready months, and their ratio."""
    ready = F.col("readiness").isin(*READY_STATES)
    means = ("predicted_mean", "observed_mean", "mae", "rmse", "bias", "wape_pct", "smape_pct", "rmae_pct", "cvrmse_pct")
    keys = ["grp", "variable", "unit", "domain", "use"]
    metrics, median = median_of_group(metrics, keys, "correlation", "_middle")
    rows = metrics.groupBy(*keys).agg(
        F.countDistinct("forecast_month").alias("n_months"), *(F.avg(c).alias(c if c.endswith("_mean") else f"mean_{c}") for c in means),
        F.avg(F.abs("bias")).alias("mean_abs_bias"), F.avg("correlation").alias("mean_corr"), median.alias("median_corr"),
        F.avg(F.col("correlation") * F.col("correlation")).alias("mean_r2_corr_squared"), F.countDistinct(F.when(ready, F.col("forecast_month"))).alias("ready_or_usable_months"))
    return rows.withColumn("readiness_ratio", F.try_divide("ready_or_usable_months", "n_months")).orderBy(F.desc_nulls_last("readiness_ratio"), F.desc_nulls_last("mean_corr"))


def validation_state(ratio="readiness_ratio", use="use") -> Column:
    return F.when(col(ratio) >= 0.8, "high_or_context_ready").when(col(ratio) >= 0.4, "medium_promising").when(col(use).isin("context_layer", "diagnostic", "technical_context"), "context_or_diagnostic").otherwise("exploratory")


def indicator_map(board: DataFrame) -> DataFrame:
    return attach_metadata(board.drop("domain", "use")).withColumn("validation_state", validation_state())


def coverage(metrics: DataFrame) -> DataFrame:
    """Per year the number of forecast months and their list."""
    months = F.sort_array(F.collect_set(F.month("forecast_month")))
    return metrics.groupBy(F.year("forecast_month").alias("year")).agg(F.countDistinct("forecast_month").alias("n_months"), F.array_join(F.transform(months, lambda m: m.cast("string")), ", ").alias("months"))


CURATED_MEANS = ("predicted_mean", "observed_mean", "mae", "rmse", "bias", "correlation", "wape_pct", "smape_pct", "rmae_pct")


def curated_by_month(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("grp", "variable", "forecast_month").agg(*(F.avg(c).alias(c) for c in CURATED_MEANS))


def curated_by_year(by_month: DataFrame) -> DataFrame:
    """Mean of the months' means."""
    return by_month.groupBy("grp", "variable", F.year("forecast_month").alias("year")).agg(*(F.avg(c).alias(c) for c in CURATED_MEANS))


def area_summary(pairs: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of every area and of the full grid; an area without cells has counts of 0."""
    return area_metrics(pairs, areas, keys).withColumn("within_3pct", F.coalesce(F.col("rmae_pct") <= 3.0, F.lit(False)))


def case_validation(cases: DataFrame, limit: float = 3.0) -> DataFrame:
    """Errors of each case (temperature in percent of Kelvin) and whether they stay within the limit."""
    t, p, s = ("temperature_predicted_c", "temperature_observed_c"), ("precipitation_predicted_mm", "precipitation_observed_mm"), ("species_predicted_proxy", "species_observed_proxy")
    out = cases.withColumns({
        "temperature_abs_error_c": F.abs(F.col(t[0]) - F.col(t[1])), "temperature_error_pct_kelvin": pct_error_kelvin(*t),
        "precipitation_abs_error_mm": F.abs(F.col(p[0]) - F.col(p[1])), "precipitation_error_pct": pct_error(*p),
        "species_abs_error_proxy": F.abs(F.col(s[0]) - F.col(s[1])), "species_error_pct_proxy": pct_error(*s),
    })
    within = lambda c: F.coalesce(F.col(c) <= limit, F.lit(False))
    out = out.withColumns({"temperature_pass": within("temperature_error_pct_kelvin"), "precipitation_pass": within("precipitation_error_pct"), "species_pass": within("species_error_pct_proxy")})
    return out.withColumn("overall_pass", F.col("temperature_pass") & F.col("precipitation_pass") & F.col("species_pass"))


def by_city(cases: DataFrame) -> DataFrame:
    mean = ("temperature_abs_error_c", "temperature_error_pct_kelvin", "precipitation_abs_error_mm", "precipitation_error_pct", "species_abs_error_proxy", "species_error_pct_proxy")
    return cases.groupBy("city").agg(F.count("*").alias("case_count"), *(F.avg(c).alias(f"mean_{c}") for c in mean), (F.avg(F.col("overall_pass").cast("int")) * 100.0).alias("overall_pass_rate_pct"))


def validation_summary(cases: DataFrame) -> DataFrame:
    """One row over all validated cases; without cases counts and means are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.agg(
        F.count("*").alias("case_count"), F.countDistinct("city").alias("city_count"), F.count_if("overall_pass").alias("overall_pass_count"), zero(F.avg(F.col("overall_pass").cast("int")) * 100.0).alias("overall_pass_rate_pct"),
        zero(F.avg("temperature_error_pct_kelvin")).alias("temperature_mean_error_pct_kelvin"), zero(F.avg("precipitation_error_pct")).alias("precipitation_mean_error_pct"), zero(F.avg("species_error_pct_proxy")).alias("species_mean_error_pct_proxy"))


def history_upsert(previous: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append and keep the last batch's row per key; batches are numbered by seq, never by row order. Of
    rows of one key and batch the greatest in the other columns stays, in order of their names."""
    rows = previous.unionByName(new, allowMissingColumns=True)
    rest = sorted(c for c in rows.columns if c not in (*keys, "seq"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("seq"), *(F.desc_nulls_last(c) for c in rest)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def top_species(comparison: DataFrame, n: int, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mae"), "variable"))
    return comparison.withColumn("rank", rank).where(F.col("rank") <= n)


def dedupe_areas(areas: DataFrame) -> DataFrame:
    """Of areas with the same box the first."""
    first = F.row_number().over(Window.partitionBy("min_lat", "max_lat", "min_lon", "max_lon").orderBy("seq"))
    return areas.withColumn("_n", first).where("_n = 1").drop("_n")


def run_sanity(runs: DataFrame) -> DataFrame:
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = runs.withColumns({
        "paths_differ": F.coalesce(F.col("prediction_path") != F.col("observed_path"), F.lit(False)),
        "predicted_month_ok": same("predicted_last_month", "forecast_month"), "observed_month_ok": same("observed_last_month", "forecast_month"),
        "input_alignment_ok": same("observed_previous_month", "input_last_month"), "lead_time_match": same("lead_predicted", "lead_observed"),
        "identical_maps": F.coalesce((F.abs("t2m_mae") < 1e-8) & (F.abs("tp_mae") < 1e-8), F.lit(False)),
    })
    return out.withColumn("sanity_pass", F.col("paths_differ") & F.col("predicted_month_ok") & F.col("observed_month_ok") & F.col("input_alignment_ok") & F.col("lead_time_match"))


#: Group, status in clean mode, status otherwise (None: by the atmosphere flag).
SOURCE_STATUS = (
    ("surface", "real", "real"), ("edaphic", "real", "real"), ("atmospheric", None, None), ("climate", "real", "real"), ("species", "real", "real"),
    ("vegetation", "placeholder_zero_clean_input_mode", "prefer_ndvi_tiff_then_csv_else_lai_proxy"), ("land", "real_from_surface_lsm", "real_from_surface_lsm"),
    ("agriculture", "placeholder_zero_clean_input_mode", "real_from_europe_agriculture_csv"), ("forest", "placeholder_zero_clean_input_mode", "real_from_europe_forest_csv"),
    ("redlist", "placeholder_zero", "placeholder_zero"), ("misc", "placeholder_zero", "placeholder_zero"),
    ("land_vegetation_dataset_available", "skipped_clean_input_mode", "prefer_land_ndvi_tiff_then_csv_else_lai_proxy"),
)


def source_status(runs: DataFrame) -> DataFrame:
    """Per run and group whether its input is real or a placeholder, from input_mode and atmosphere."""
    table = runs.sparkSession.createDataFrame(SOURCE_STATUS, "grp string, clean string, rest string")
    told = F.when(F.col("grp") == "atmospheric", F.when(F.col("atmosphere"), "real").otherwise("placeholder_zero_fast_smoke_test")).when(F.col("input_mode") == "clean", F.col("clean")).otherwise(F.col("rest"))
    return runs.join(F.broadcast(table)).withColumn("source_status", told).drop("clean", "rest")
