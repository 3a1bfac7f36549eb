"""Trends and indicators of area series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.operators.landcover import composite


def with_position(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row position by month within an area; rows without a value take one too."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1).cast("double"))


def slope(value) -> Column:
    """Least squares slope over positions, NULL under two values."""
    return F.when(F.count(value) >= 2, F.regr_slope(value, F.col("pos")))


def linear_slope(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return with_position(df, keys).groupBy(*keys).agg(slope(F.col(value)).alias("slope"))


def mean_present(*cols: Column) -> Column:
    """Mean of those that are present."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n)


def kpis(df: DataFrame, keys: list[str]) -> DataFrame:
    """Thermal stress, soil moisture and greenness trends, mean temperature, land cover change."""
    rows = with_position(df, keys).withColumns({"moisture": mean_present(F.col("swvl1"), F.col("swvl2")), "cover": composite()})
    s = rows.groupBy(*keys).agg(
        *(slope(F.col(c)).alias(f"s_{c}") for c in ("t", "stl1", "stl2")), slope(F.col("moisture")).alias("soil_moisture_trend"), slope(F.col("ndvi")).alias("ndvi_trend"),
        F.avg("t").alias("mean_temperature"), F.count("*").alias("n"), F.min_by("cover", "month").alias("first_cover"), F.max_by("cover", "month").alias("last_cover"))
    change = F.when(F.col("n") >= 2, F.col("last_cover") - F.col("first_cover"))
    return s.select(*keys, mean_present(F.col("s_t"), F.col("s_stl1"), F.col("s_stl2")).alias("thermal_stress"), "soil_moisture_trend", "ndvi_trend", "mean_temperature", change.alias("landcover_change"))


def trend_summary(df: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """First, last and extreme values of each variable, and the change from first to last."""
    rows = df.select(*keys, "month", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))).alias("r")).select(*keys, "month", "r.*").where("value is not null")
    told = rows.groupBy(*keys, "variable").agg(F.min_by("value", "month").alias("first_value"), F.max_by("value", "month").alias("last_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return told.withColumn("delta", F.col("last_value") - F.col("first_value"))


def color_scale(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Value between a map's extremes, in [0, 1]; a constant map gives 0, missing stays missing."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.col(value).isNull(), None).when(span == 0, 0.0).otherwise(F.least(F.greatest((F.col(value) - F.col("_lo")) / span, F.lit(0.0)), F.lit(1.0)))
    return df.join(ends, keys).withColumn("scaled", scaled).drop("_lo", "_hi")
