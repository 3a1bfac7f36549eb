"""Observed assessment: species counts, climate layers, cell and area months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.grid import STEP, cell_keys, inside, snap_to_grid
from gridjobs.functions.tables import few
from gridjobs.functions.months import days_in_month, filter_months, month_start
from gridjobs.functions.values import col

AREA_MEANS = ("temperature_mean_c", "precipitation_mean_mm", "precipitation_mean_daily_mm", "ndvi_mean", "swvl1_mean", "swvl2_mean", "stl1_mean", "stl2_mean", "cropland_mean", "arable_mean", "forest_mean")


def species_cell_month(occ: DataFrame, bounds=None, start=None, end=None, max_steps=None, approximate: bool = False) -> DataFrame:
    """Distinct species per month and cell; the box applies after snapping. Months count if they have records."""
    rows = snap_to_grid(occ.dropna(subset=["species", "latitude", "longitude", "ts"])).withColumn("month", month_start("ts"))
    if bounds:
        rows = rows.where(inside(bounds))
    if start:
        rows = filter_months(rows, start, end, max_steps)
    if approximate:
        count = F.approx_count_distinct("species")
        return rows.groupBy("month", "lat_i", "lon_i").agg(count.alias("species_count"))
    # distinct first: a busy cell's records shrink to its species before the count
    few = rows.select("month", "lat_i", "lon_i", "species").distinct()
    return few.groupBy("month", "lat_i", "lon_i").agg(F.count("*").alias("species_count"))


def species_area_month(occ: DataFrame, bounds=None, start=None, end=None, max_steps=None) -> DataFrame:
    """Distinct species per month of an area; the box applies to the raw coordinates."""
    rows = occ.dropna(subset=["species", "latitude", "longitude", "ts"]).withColumn("month", month_start("ts"))
    if bounds:
        rows = rows.where(inside(bounds))
    if start:
        rows = filter_months(rows, start, end, max_steps)
    return rows.select("month", "species").distinct().groupBy("month").agg(F.count("*").alias("species_count_observed_area"))


def species_records(occ: DataFrame) -> DataFrame:
    """Months, species and grid cells with a record: the sparse form of presence."""
    return snap_to_grid(occ.dropna()).select(month_start("ts").alias("month"), "species", "lat_i", "lon_i").distinct()


def species_presence(occ: DataFrame, cells: DataFrame, species: DataFrame, months: DataFrame) -> DataFrame:
    """1 where a listed species has a record in a month and grid cell, 0 elsewhere: the dense form of species_records."""
    seen = species_records(occ).withColumn("presence", F.lit(1))
    frame = cells.select("lat_i", "lon_i").crossJoin(few(months.select("month").distinct())).crossJoin(few(species.select("species").distinct()))
    return frame.join(seen, ["month", "species", "lat_i", "lon_i"], "left").withColumn("presence", F.coalesce("presence", F.lit(0)))


def first_matching_step(grid: DataFrame, keys=("variable", "month", "lat_i", "lon_i"), time: str = "valid_time") -> DataFrame:
    """Of several time steps of one month the first; of equal ones the least in the other columns."""
    rest = sorted(c for c in grid.columns if c not in (*keys, time))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(time, *rest))
    return grid.withColumn("_n", first).where("_n = 1").drop("_n")


def land_mask(grid: DataFrame) -> DataFrame:
    """Cells whose land share at the first time step is over a half."""
    first = grid.where(F.col("lsm").isNotNull()).groupBy("lat_i", "lon_i").agg(F.min_by("lsm", "month").alias("lsm"))
    return first.where(F.col("lsm") > 0.5).select("lat_i", "lon_i")


def apply_land_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    return df.join(mask, ["lat_i", "lon_i"], "left_semi")


def precipitation_mm(df: DataFrame) -> DataFrame:
    """Daily and monthly millimetres: from avg_tprate if the source has it, else from tp, else NULL."""
    days = days_in_month("month").cast("double")
    if "avg_tprate" in df.columns:
        daily = F.col("avg_tprate") * 86400.0
        return df.withColumns({"precipitation_mean_daily_mm": daily, "precipitation_mean_mm": daily * days})
    if "tp" in df.columns:
        monthly = F.col("tp") * 1000.0
        return df.withColumns({"precipitation_mean_daily_mm": monthly / days, "precipitation_mean_mm": monthly})
    return df.withColumns({"precipitation_mean_daily_mm": F.lit(None).cast("double"), "precipitation_mean_mm": F.lit(None).cast("double")})


def ndvi_from_lai(high="lai_hv", low="lai_lv", land=None) -> Column:
    """Greenness of land from leaf area, a missing part counting 0; missing at sea.

    land: whether the cell is land, or nothing if all rows are.
    """
    lai = F.coalesce(col(high), F.lit(0.0)) + F.coalesce(col(low), F.lit(0.0))
    value = F.least(F.greatest(1.0 - F.exp(-0.5 * lai), F.lit(0.0)), F.lit(0.92))
    return value if land is None else F.when(col(land), value)


def primary_fallback(primary: DataFrame, fallback: DataFrame, value: str, keys=("month", "lat_i", "lon_i")) -> DataFrame:
    """The primary layer's value where present, else the fallback's."""
    both = primary.select(*keys, F.col(value).alias("_p")).join(fallback.select(*keys, F.col(value).alias("_f")), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_p", "_f").alias(value))


def monthly_layer(table: DataFrame, value: str, name: str) -> DataFrame:
    """Mean of duplicates per month and cell, missing values left out."""
    return table.where(F.col(value).isNotNull()).groupBy("month", "lat_i", "lon_i").agg(F.avg(value).alias(name))


def static_broadcast(df: DataFrame, months: DataFrame) -> DataFrame:
    """A layer without time, for every month (a dimension of distinct months)."""
    return df.crossJoin(few(months.select("month").distinct()))


def yearly_asof(land: DataFrame, months: DataFrame, variable: str) -> DataFrame:
    """For every month the table's latest year up to the month's; the choice is the table's, not a cell's."""
    table = land.where(F.col("variable") == variable)
    years = table.select("year").distinct()
    wanted = months.select("month", F.year("month").alias("y")).distinct()
    chosen = wanted.join(few(years), F.col("year") <= F.col("y")).groupBy("month").agg(F.max("year").alias("year"))
    layer = table.where(F.col("value").isNotNull()).groupBy("year", "lat_i", "lon_i").agg(F.avg("value").alias("value"))
    return layer.join(few(chosen), "year").select("month", "lat_i", "lon_i", "value", F.col("year").alias("source_year"))


def yearly_asof_wide(land: DataFrame, months: DataFrame, names: dict[str, str]) -> DataFrame:
    """yearly_asof of several variables side by side: (month, lat_i, lon_i) and a column for each name.

    One filter, one mean per year and cell, and one pivot, however many variables there are.
    """
    table = land.where(F.col("variable").isin(*names))
    years = table.select("variable", "year").distinct()
    wanted = months.select("month", F.year("month").alias("y")).distinct()
    # small dimensions: variables times years, and months
    chosen = wanted.crossJoin(few(years)).where(F.col("year") <= F.col("y")).groupBy("month", "variable").agg(F.max("year").alias("year"))
    layer = table.where(F.col("value").isNotNull()).groupBy("variable", "year", "lat_i", "lon_i").agg(F.avg("value").alias("value"))
    rows = layer.join(few(chosen), ["variable", "year"])
    return rows.groupBy("month", "lat_i", "lon_i").agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(n) for v, n in names.items()))


def drop_all_missing(df: DataFrame, columns) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def weighted_mean(value, weight="latitude_weight") -> Column:
    """Sum of v w over sum of w, over rows with both; none gives NULL."""
    v, w = col(value), col(weight)
    both = F.sum(F.when(v.isNotNull(), w))
    return F.when(both != 0, F.sum(v * w) / both)


def weighted_land_series(grid: DataFrame, value: str, transform=lambda c: c) -> DataFrame:
    land = cell_keys(apply_land_mask(grid, land_mask(grid)))
    return land.groupBy("month").agg(transform(weighted_mean(value)).alias("value"))


def cell_month(climate: DataFrame, species: DataFrame, layers: DataFrame, ndvi: DataFrame | None = None) -> DataFrame:
    """The wide cell table: climate rows of land cells with any value, and what other layers know of them.

    layers: yearly_asof_wide. ndvi: a table of its own, if ndvi_mean is no column of climate. All joins
    are equi-joins on (month, lat_i, lon_i), so one partitioning serves them.
    """
    keys = ["month", "lat_i", "lon_i"]
    base = precipitation_mm(climate).withColumn("temperature_mean_c", F.col("t2m") - 273.15)
    base = base.withColumns({"swvl1_mean": F.col("swvl1"), "swvl2_mean": F.col("swvl2"), "stl1_mean": F.col("stl1") - 273.15, "stl2_mean": F.col("stl2") - 273.15})
    base = drop_all_missing(base, ("temperature_mean_c", "precipitation_mean_mm", "swvl1_mean", "swvl2_mean", "stl1_mean", "stl2_mean"))
    out = apply_land_mask(base, land_mask(climate)).select(*keys, *(c for c in AREA_MEANS if c in base.columns))
    if ndvi is not None:
        out = out.join(ndvi.select(*keys, "ndvi_mean"), keys, "left")
    out = out.join(layers, keys, "left")
    out = out.join(species.select(*keys, F.col("species_count").alias("species_count_observed_cell")), keys, "left")
    return cell_keys(out.withColumns({"latitude": F.col("lat_i") * STEP, "longitude": F.col("lon_i") * STEP}))


def area_month(cells: DataFrame, keys=("month",), means=AREA_MEANS) -> DataFrame:
    """Latitude-weighted means per area and month, with counts of cells."""
    known = F.coalesce(*(F.col(c) for c in means if c != "precipitation_mean_daily_mm"))
    aggregates = [weighted_mean(c).alias(c.replace("_mean", "_mean_area", 1)) for c in means]
    counts = [F.count_if(known.isNotNull()).alias("valid_cell_count"), F.count("*").alias("cell_count_land")]
    if "species_count_observed_cell" in cells.columns:
        counts.append(F.count_if(F.col("species_count_observed_cell") > 0).alias("cells_with_species_records"))
    return cells.groupBy(*keys).agg(*aggregates, *counts)


def area_with_species(area: DataFrame, species: DataFrame) -> DataFrame:
    return area.join(species, "month", "full_outer")


def batch_area_summary(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Area means whose weight sum includes cells without a value, as one forecast summary does."""
    total = F.sum("latitude_weight")
    mean = lambda c: F.when(total != 0, F.sum(F.col(c) * F.col("latitude_weight")) / total)
    return cell_keys(grid).groupBy(*keys).agg((mean("t2m") - 273.15).alias("temperature_mean_area_c"), (mean("tp") * 1000.0).alias("precipitation_mean_area_mm"), F.count("*").alias("cell_count"))


def batch_species_summary(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Species whose strongest signal in an area reaches the threshold."""
    top = pairs.groupBy(*keys, "species").agg(F.max("predicted").alias("signal"))
    return top.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("signal") >= threshold, F.lit(False))).alias("species_count_area_proxy"), F.max("signal").alias("max_signal"))


def area_deltas(predicted: DataFrame, observed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    two = predicted.select(*keys, *(F.col(v).alias(f"_p_{v}") for v in values)).join(observed.select(*keys, *(F.col(v).alias(f"_o_{v}") for v in values)), keys)
    return two.select(*keys, *(F.abs(F.col(f"_p_{v}") - F.col(f"_o_{v}")).alias(f"{v}_delta") for v in values))
