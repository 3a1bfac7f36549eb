"""Land cover: class masks, regridding, yearly tables, carry-forward and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.grid import snap_to_grid
from gridjobs.functions.tables import few
from gridjobs.functions.values import col

#: Class codes counted as arable and as cropland, and the last official year.
ARABLE_CODES = (1110, 1120, 1130, 1140, 1150, 1210, 1220, 1310, 1320, 1410, 1420, 1430, 1440, 3100)
CROPLAND_CODES = (1110, 1120, 1130, 1140, 1150, 1210, 1220, 1310, 1320, 1410, 1420, 1430, 1440, 2100, 2200, 2310, 2320, 3100, 3200)
CUTOFF_YEAR = 2023


def class_mask(code, codes) -> Column:
    """100 for listed classes, 0 for all others, pixels without data included."""
    return F.when(F.coalesce(col(code).isin(*codes), F.lit(False)), 100.0).otherwise(0.0)


def valid_range(value, nodata, low: float = 0.0, high: float = 100.0) -> Column:
    v = col(value)
    return F.when(v.between(low, high) & ~F.coalesce(v == col(nodata), F.lit(False)), v)


def composite(forest="forest", arable="arable", cropland="cropland") -> Column:
    return col(forest) - (col(arable) + col(cropland))


def regrid_pixels(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Mean of valid pixels per tile and cell; where tiles overlap the later one that has data wins."""
    per_tile = snap_to_grid(pixels).where(F.col(value).isNotNull()).groupBy("tile_seq", "lat_i", "lon_i").agg(F.avg(value).alias("v"))
    return per_tile.groupBy("lat_i", "lon_i").agg(F.max_by("v", "tile_seq").alias("value"), F.max("tile_seq").alias("tile_seq"))


def upsert_year(target: DataFrame, incoming: DataFrame, keys: list[str], overwrite: bool) -> DataFrame:
    """Full outer union of one year's values: overwrite prefers incoming ones, else old ones stay."""
    both = target.select(*keys, F.col("value").alias("_old")).join(incoming.select(*keys, F.col("value").alias("_new")), keys, "full_outer")
    order = ("_new", "_old") if overwrite else ("_old", "_new")
    return both.select(*keys, F.coalesce(*order).alias("value"))


def carry_forward(land: DataFrame, years: DataFrame, cutoff: int = CUTOFF_YEAR, overwrite: bool = False) -> DataFrame:
    """Give wanted years over the cutoff the values of each variable's latest year up to it.

    Existing years are kept; with overwrite a present source value replaces them. mode and source_year
    tell where a value is from.
    """
    keys = ["latitude", "longitude", "variable"]
    latest = land.where(F.col("year") <= cutoff).groupBy("variable").agg(F.max("year").alias("source_year"))
    source = land.join(latest, "variable").where(F.col("year") == F.col("source_year")).select(*keys, "source_year", F.col("value").alias("_from"))
    wanted = source.crossJoin(few(years.where(F.col("year") > cutoff).distinct()))
    both = land.select(*keys, "year", "value", F.lit(True).alias("_has")).join(wanted, [*keys, "year"], "full_outer")
    known = both.join(land.select("variable", "year").distinct().withColumn("_year", F.lit(True)), ["variable", "year"], "left")
    take = F.col("_from").isNotNull() if overwrite else F.col("_year").isNull()
    return known.where(F.col("_has") | take).select(
        *keys, "year", F.when(take, F.col("_from")).otherwise(F.col("value")).alias("value"),
        F.when(take, "carry_forward").otherwise("official").alias("mode"), F.when(take, F.col("source_year")).otherwise(F.col("year")).alias("source_year"))


def provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per year, the newest replacing; of several of one time the greatest in the other columns."""
    rows = old.unionByName(new)
    told = F.struct("mode", "source_year", "source_file")
    return rows.groupBy("year").agg(F.max_by(told, F.struct(F.col("ingested_at"), told)).alias("r"), F.max("ingested_at").alias("ingested_at")).select("year", "r.*", "ingested_at")


def sort_landcover(df: DataFrame) -> DataFrame:
    """Variables in their fixed order, then latitude and longitude; keys, others, then years as columns."""
    order = F.array_position(F.array(*map(F.lit, ("Agriculture", "Arable", "Cropland"))), F.col("variable"))
    years = sorted(c for c in df.columns if c[-4:].isdigit())
    keys = [c for c in ("latitude", "longitude", "variable") if c in df.columns]
    return df.select(*keys, *(c for c in df.columns if c not in {*keys, *years}), *years).orderBy(order, "latitude", "longitude")
