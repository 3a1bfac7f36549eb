"""Audits: inventories, ranges, signals, profiles, samples, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.values import display_unit, display_value, finite
from gridjobs.functions.grid import inside
from gridjobs.functions.tables import few
from gridjobs.operators.quantiles import column_quantiles, median_exceeds


def variable_inventory(grid: DataFrame, value: str = "value") -> DataFrame:
    v = finite(value)
    return grid.groupBy("grp", "variable").agg(
        F.count_if(v.isNotNull()).alias("finite_count"), F.count_if(v.isNull()).alias("missing_count"), F.count_if(v == 0).alias("zero_count"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value")).withColumn("display_unit", display_unit("variable"))


def source_ranges(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def common_period(ranges: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """From the latest start to the earliest end of the core sources; others do not limit it."""
    return ranges.where(F.col("source").isin(*core)).agg(F.max("first_month").alias("start"), F.min("last_month").alias("end"))


def month_signal(table: DataFrame, value: str = "value") -> DataFrame:
    """Per month the values that are not about zero, and whether there are any."""
    v = finite(value)
    s = F.when(F.abs(v) > 1e-8, v)
    return table.groupBy("month").agg(F.count(s).alias("signal_count"), F.min(s).alias("signal_min"), F.avg(s).alias("signal_mean"), F.max(s).alias("signal_max")).withColumn("ok", F.col("signal_count") > 0)


def require_signal(ranked: DataFrame) -> DataFrame:
    """Per month the first source, by priority, whose map has a signal."""
    good = ranked.where(F.abs("value") > 1e-8).groupBy("month", "source", "priority").agg(F.count("*").alias("cells"))
    return good.groupBy("month").agg(F.min_by("source", "priority").alias("source"), F.min_by("cells", "priority").alias("cells"))


def precip_audit(grid: DataFrame, bounds, value: str = "tp") -> DataFrame:
    """Raw statistics of the whole domain and of an area, from one pass."""
    out = []
    for scope, v in (("domain", F.col(value)), ("area", F.when(inside(bounds), F.col(value)))):
        out += [F.count(v).alias(f"{scope}_count"), F.min(v).alias(f"{scope}_min"), F.avg(v).alias(f"{scope}_mean"), F.max(v).alias(f"{scope}_max")]
    return grid.agg(*out)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing count and share, and for numbers their describing statistics.

    One pass for all but the quartiles, which come by column_quantiles. Of an empty table counts are 0 and
    the rest is null.
    """
    kinds = dict(df.dtypes)
    numeric = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    rows = []
    for c in columns:
        v = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.count_if(F.col(c).isNull()).alias("missing"), (F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100.0).alias("missing_pct"),
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")))
    told = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if not numeric:
        return told.select("*", *(F.lit(None).cast("double").alias(q) for q in ("q25", "q50", "q75")))
    quartiles = column_quantiles(df, numeric).select("column_name", *(F.element_at("q", k + 1).alias(q) for k, q in enumerate(("q25", "q50", "q75"))))
    return told.join(F.broadcast(quartiles), "column_name", "left")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    width = (high - low) / bins
    bucket = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def gap_matrix(sources: DataFrame, months: DataFrame) -> DataFrame:
    """Every source and month with whether it has data; both dimensions are small."""
    frame = sources.select("source").distinct().crossJoin(few(months.select("month").distinct()))
    have = sources.select("source", "month").distinct().withColumn("available", F.lit(True))
    return frame.join(have, ["source", "month"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def month_cells(cells: DataFrame, month: str, columns: list[str]) -> DataFrame:
    """Cells of one month (a partition of the written table), values as nullable numbers."""
    return cells.where(F.col("month") == F.lit(month).cast("date")).select("lat_i", "lon_i", *(finite(c).alias(c) for c in columns))


def selection_error(city="city", lat="lat", lon="lon", box="bbox", start="start_date", end="end_date"):
    """NULL if exactly one of city, point and box is given and both dates are, else what is wrong."""
    given = sum((F.when(c, 1).otherwise(0) for c in (F.col(city).isNotNull(), F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.col(box).isNotNull())), F.lit(0))
    half = F.col(lat).isNull() != F.col(lon).isNull()
    dates = F.col(start).isNull() | F.col(end).isNull()
    return F.when(half, "point needs both coordinates").when(given == 0, "no area given").when(given > 1, "more than one area given").when(dates, "both dates are needed").when(F.col(start) > F.col(end), "dates are reversed")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes by extension, and unfinished or lock files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("path").rlike(r"\.(part|incomplete|tmp)$")).alias("incomplete"), F.count_if(F.col("path").rlike(r"\.lock$")).alias("locks"))


def source_sample(grid: DataFrame, variable: str, value: str = "value") -> DataFrame:
    """Rows, time range, and mean of the first month in display units."""
    first = grid.agg(F.min("month").alias("_m"))
    rows = grid.join(F.broadcast(first))
    shown = display_value(F.lit(variable), value)
    return rows.agg(F.count("*").alias("rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.avg(F.when(F.col("month") == F.col("_m"), shown)).alias("first_mean"))


def sample_points(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """A repeatable sample: the n rows of least md5 of seed and keys, the same in any engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), *keys).limit(n)


def best_source(candidates: DataFrame) -> DataFrame:
    """Per purpose the candidate of highest kind, then latest month, then size."""
    return candidates.groupBy("purpose").agg(F.max_by("path", F.struct("kind", "latest", "size", "path")).alias("path"))


def scale(df: DataFrame, stats: DataFrame, mode: str = "minmax", inverse: bool = False) -> DataFrame:
    """Scale values by statistics of their variable and level, or undo it; without statistics no change."""
    rows = df.join(stats.withColumnsRenamed({"variable": "_v", "level": "_l"}), (F.col("variable") == F.col("_v")) & F.col("level").eqNullSafe(F.col("_l")), "left").drop("_v", "_l")
    shift, width = (F.col("stat_min"), F.col("stat_max") - F.col("stat_min")) if mode == "minmax" else (F.col("stat_mean"), F.col("stat_std"))
    v = F.col("value") * width + shift if inverse else (F.col("value") - shift) / width
    return rows.withColumn("value", F.when(width != 0, v).otherwise(F.col("value"))).drop("stat_min", "stat_max", "stat_mean", "stat_std")


def kelvin_guard(layers: DataFrame) -> DataFrame:
    """Convert temperature layers that look like Kelvin: by name, or by the median of a month's map.

    Whether a median is over the limit is told by counts around it, a few numbers for each map.
    """
    temps = F.col("variable").isin("temperature", "stl1", "stl2")
    maps = layers.groupBy("month", "variable").agg(median_exceeds(F.abs("value"), 150).alias("_hot"))
    rows = layers.join(maps, ["month", "variable"])
    kelvin = temps & (F.endswith("column_name", F.lit("_native")) | F.col("_hot"))
    return rows.withColumn("value", F.when(kelvin, F.col("value") - 273.15).otherwise(F.col("value"))).drop("_hot")


#: Groups that are always zero, and those that are in mode clean.
ZERO_GROUPS, CLEAN_GROUPS = ("redlist", "misc"), ("vegetation", "agriculture", "forest")


def with_land(groups: DataFrame) -> DataFrame:
    """groups whose land group's Land is a copy of the surface group's lsm."""
    land = groups.where((F.col("grp") == "surface") & (F.col("variable") == "lsm")).withColumns({"grp": F.lit("land"), "variable": F.lit("Land")})
    return groups.where((F.col("grp") != "land") | (F.col("variable") != "Land")).unionByName(land)


def dense_batches(groups: DataFrame, cells: DataFrame, variables: DataFrame, months: DataFrame, mode: str = "all", atmosphere: bool = True) -> DataFrame:
    """(month, grp, variable, level, lat_i, lon_i, value): every listed map of every month on every cell.

    groups: the known values (month, grp, variable, level, lat_i, lon_i, value), sparse; the greatest of a
    cell counts. variables: grp, variable and levels (array<int>; null or empty for a variable without).
    months: the months wanted. Where nothing is known a cell is zero, as are placeholder groups, in mode
    clean also vegetation, agriculture and forest, and the atmospheric group without atmosphere. Land is
    a copy of lsm. Only the sparse rows are shuffled, by map; the cells of a map are made where its rows
    are, from one list of all cells (the model grid; it goes to every task).
    """
    one = ["month", "grp", "variable", "level"]
    levels = F.when(F.coalesce(F.size("levels"), F.lit(0)) > 0, F.col("levels")).otherwise(F.array(F.lit(None).cast("int")))
    listed = variables.select("grp", "variable", F.explode(levels).alias("level")).distinct()
    wanted = months.select("month").distinct().crossJoin(few(listed))
    empty = F.col("grp").isin(*ZERO_GROUPS, *(CLEAN_GROUPS if mode == "clean" else ()), *(() if atmosphere else ("atmospheric",)))
    known = with_land(groups).where(~empty & F.col("value").isNotNull()).select(*one, "lat_i", "lon_i", F.col("value").cast("double").alias("value"), F.lit(False).alias("listed"))
    no = lambda kind: F.lit(None).cast(kind)
    marks = wanted.select(*one, no("int").alias("lat_i"), no("int").alias("lon_i"), no("double").alias("value"), F.lit(True).alias("listed"))
    maps = known.unionByName(marks).repartition(*one)
    cell = lambda value: F.struct(F.col("lat_i").cast("int").alias("lat_i"), F.col("lon_i").cast("int").alias("lon_i"), value.alias("value"))
    every = cells.select("lat_i", "lon_i").distinct().agg(F.collect_list(cell(no("double"))).alias("_cells"))  # one row
    rows = maps.crossJoin(F.broadcast(every)).select(*one, "listed", F.explode(F.when(F.col("listed"), F.col("_cells")).otherwise(F.array(cell(F.col("value"))))).alias("c")).select(*one, "listed", "c.*")
    dense = rows.groupBy(*one, "lat_i", "lon_i").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"), F.max("listed").alias("listed"))
    return dense.where("listed").drop("listed")


def dense_batch(groups: DataFrame, cells: DataFrame, variables: DataFrame, mode: str = "all") -> DataFrame:
    """Every listed variable of one month and no level on every cell; see dense_batches."""
    at = groups.select(F.lit(None).cast("date").alias("month"), "grp", "variable", F.lit(None).cast("int").alias("level"), "lat_i", "lon_i", "value")
    listed = variables.select("grp", "variable", F.lit(None).cast("array<int>").alias("levels"))
    month = variables.sparkSession.createDataFrame([(None,)], "month date")
    return dense_batches(at, cells, listed, month, mode).drop("month", "level")
