"""Species of many areas at once: exact counts on raw coordinates, and stored mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.grid import STEP, areas_range_join, inside, snap_to_grid
from gridjobs.functions.months import month_start
from gridjobs.functions.tables import few

#: Side of a block of raw cells that a box takes whole.
BLOCK = 16
SIDES = ("min_lat", "max_lat", "min_lon", "max_lon")


def raw_cell(c: str) -> Column:
    """The half-open cell [k / 4, (k + 1) / 4) of a coordinate; exact, as 4 is a power of two."""
    return F.floor(F.col(c) / STEP).cast("int")


def box_cells(areas: DataFrame, key: str = "area_label", block: int = BLOCK) -> DataFrame:
    """(key, size, lat_c, lon_c, edge, the box's sides): what covers every raw-coordinate box.

    size block: a block of cells that lies inside on all sides; size 1: a cell of the rest. edge: the box
    ends inside the cell, so its records need the test; all others are inside without one. A box of
    h x w cells takes about h w / block^2 + block (h + w) rows.
    """
    low, high = {k: raw_cell(f"min_{k}") for k in ("lat", "lon")}, {k: raw_cell(f"max_{k}") for k in ("lat", "lon")}
    known = areas.where((F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lon") <= F.col("max_lon"))).select(key, *SIDES, *(low[k].alias(f"{k}0") for k in low), *(high[k].alias(f"{k}1") for k in high))
    # whole blocks strictly between the edges
    first = {k: F.ceil((F.col(f"{k}0") + 1) / block).cast("int") for k in low}
    last = {k: (F.floor(F.col(f"{k}1") / block) - 1).cast("int") for k in low}
    known = known.withColumns({f"{k}b0": first[k] for k in low}).withColumns({f"{k}b1": last[k] for k in low})
    some = (F.col("latb0") <= F.col("latb1")) & (F.col("lonb0") <= F.col("lonb1"))
    span = lambda a, b: F.sequence(F.col(a), F.col(b))
    whole = known.where(some).withColumn("lat_c", F.explode(span("latb0", "latb1"))).withColumn("lon_c", F.explode(span("lonb0", "lonb1")))
    within = lambda k, c: F.floor(c / block).between(F.col(f"{k}b0"), F.col(f"{k}b1"))
    # of a row of cells only what no whole block covers
    rows = known.withColumn("lat_c", F.explode(span("lat0", "lat1")))
    lons = F.when(some & within("lat", F.col("lat_c")), F.filter(span("lon0", "lon1"), lambda x: ~within("lon", x))).otherwise(span("lon0", "lon1"))
    rows = rows.withColumn("lon_c", F.explode(lons))
    edge = (F.col("lat_c") == F.col("lat0")) | (F.col("lat_c") == F.col("lat1")) | (F.col("lon_c") == F.col("lon0")) | (F.col("lon_c") == F.col("lon1"))
    told = lambda df, size, e: df.select(key, F.lit(size).alias("size"), "lat_c", "lon_c", e.alias("edge"), *SIDES)
    return told(whole, block, F.lit(False)).unionByName(told(rows, 1, edge))


def species_areas(occ: DataFrame, areas: DataFrame, start: str | None = None, end: str | None = None, max_steps: int | None = None, key: str = "area_label", block: int = BLOCK) -> DataFrame:
    """(key, month, species_count_observed_area): distinct species of every area and month, by raw
    coordinates; a month of an area without records has no row.

    Records meet boxes by cell keys. Records of a cell that no box ends in count once for each month and
    species, before the join; only those of edge cells keep their coordinates and are tested. max_steps:
    an area's first so many months with records. Areas of one key count together, and areas of one box are
    looked up once.
    """
    rows = occ.dropna(subset=["species", "latitude", "longitude", "ts"]).select("species", "latitude", "longitude", month_start("ts").alias("month"))
    if start:
        rows = rows.where(F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = rows.withColumns({"lat_c": raw_cell("latitude"), "lon_c": raw_cell("longitude")})
    # areas of the same box are looked up once
    sides = F.struct(*SIDES)
    boxes = box_cells(areas.select(sides.alias("box"), *SIDES).distinct(), "box", block)
    cells = rows.select("month", "species", "lat_c", "lon_c").distinct()
    blocks = cells.select("month", "species", F.floor(F.col("lat_c") / block).cast("int").alias("lat_c"), F.floor(F.col("lon_c") / block).cast("int").alias("lon_c")).distinct()
    cell = ["lat_c", "lon_c"]
    inner = cells.join(boxes.where("size = 1 and not edge").select("box", *cell), cell).select("box", "month", "species")
    wide = blocks.join(boxes.where(f"size = {block} and not edge" if block > 1 else "false").select("box", *cell), cell).select("box", "month", "species")
    edges = rows.distinct().join(boxes.where("edge").drop("size", "edge"), cell).where(inside({k: F.col(k) for k in SIDES})).select("box", "month", "species")
    by_box = inner.unionByName(wide).unionByName(edges).distinct()
    named = few(areas.select(key, sides.alias("box")).distinct())
    found = by_box.join(named, "box").select(key, "month", "species")
    if not areas.select(key, *SIDES).distinct().groupBy(key).count().where("count > 1").isEmpty():
        found = found.distinct()
    counts = found.groupBy(key, "month").agg(F.count("*").alias("species_count_observed_area"))
    if max_steps is None:
        return counts
    place = F.row_number().over(Window.partitionBy(key).orderBy("month"))
    return counts.withColumn("_n", place).where(F.col("_n") <= max_steps).drop("_n")


#: log2 of a sketch's registers: a standard error of about 1.6 percent, 4 KB at most.
SKETCH = 12


def species_sketches(occ: DataFrame, size: int = SKETCH) -> DataFrame:
    """(month, lat_i, lon_i, records, sketch): a mergeable sketch of the species of each month and snapped
    cell, to be stored (sources.tables.write_sketches) and never made from the records again."""
    rows = snap_to_grid(occ.dropna(subset=["species", "latitude", "longitude", "ts"])).withColumn("month", month_start("ts"))
    return rows.groupBy("month", "lat_i", "lon_i").agg(F.count("*").alias("records"), F.hll_sketch_agg("species", F.lit(size)).alias("sketch"))


def sketched_areas(sketches: DataFrame, areas: DataFrame, months: int = 1, key: str = "area_label") -> DataFrame:
    """(key, period, records, sketch, species_estimate) of every area and period of so many months from
    January on (1: months, 3: quarters, 12: years), by union of stored sketches; no record is read.

    Records count for the cell they snap to, as in species_cell_month. The sketch of the row can be united
    further. Months of a year are parted evenly, so months divides 12.
    """
    if 12 % months:
        raise ValueError("a period of months must divide a year")
    first = F.month("month") - (F.month("month") - 1) % months
    at = sketches.withColumns({"latitude": F.col("lat_i") * STEP, "longitude": F.col("lon_i") * STEP, "period": F.make_date(F.year("month"), first, F.lit(1))})
    # of a cell once for each area, however many boxes of it overlap there
    mine = areas_range_join(at, areas).select(key, "period", "month", "lat_i", "lon_i", "records", "sketch").dropDuplicates([key, "month", "lat_i", "lon_i"])
    united = mine.groupBy(key, "period").agg(F.sum("records").alias("records"), F.hll_union_agg("sketch").alias("sketch"))
    return united.withColumn("species_estimate", F.hll_sketch_estimate("sketch"))
