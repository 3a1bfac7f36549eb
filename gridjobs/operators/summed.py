"""Statistics of many boxes of many maps by summed-area tables.

A map is what shares its keys (run, variable, ...). Its cells are shuffled once, by map; prefix sums along
longitude and then latitude turn the sum over a box into four lookups, and tables of the least and greatest
value of blocks of 2^a x 2^b cells turn an extreme into four more. Only the rows at corners of boxes meet
the areas, so the work after the tables grows with the number of areas, not with the cells in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.grid import STEP, cell_keys
from gridjobs.functions.tables import few
from gridjobs.functions.values import EPS, finite, ratio
from gridjobs.operators.metrics import continuous_metrics, valid_pair


def by_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The one shuffle: all rows of a map in one partition, maps spread over as many partitions as the
    session has for shuffles. They are not joined to fewer, as a few cells give rows for many areas."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def frame_of(rows: DataFrame) -> dict[str, int] | None:
    """The least and greatest cell keys of all maps, None without cells."""
    r = rows.agg(*(f(c).alias(n) for c, f, n in (("lat_i", F.min, "lat0"), ("lat_i", F.max, "lat1"), ("lon_i", F.min, "lon0"), ("lon_i", F.max, "lon1")))).first()
    return None if r["lat0"] is None or r["lon0"] is None else r.asDict()


def cell_boxes(areas: DataFrame, frame: dict[str, int], key: str) -> DataFrame:
    """(key, box, lat0, lat1, lon0, lon1): the cells of every area inside the frame, and one number for
    the four sides; box -1 and null sides if there are none. A grid coordinate is its key times a power of
    two, so no cell is misplaced."""
    low = lambda c, least: F.greatest(F.ceil(F.col(c) / STEP).cast("int"), F.lit(least))
    high = lambda c, most: F.least(F.floor(F.col(c) / STEP).cast("int"), F.lit(most))
    sides = {"lat0": low("min_lat", frame["lat0"]), "lat1": high("max_lat", frame["lat1"]), "lon0": low("min_lon", frame["lon0"]), "lon1": high("max_lon", frame["lon1"])}
    known = F.col("min_lat").isNotNull() & F.col("max_lat").isNotNull() & F.col("min_lon").isNotNull() & F.col("max_lon").isNotNull()
    rows = areas.select(key, known.alias("_known"), *(c.alias(n) for n, c in sides.items()))
    full = F.col("_known") & (F.col("lat0") <= F.col("lat1")) & (F.col("lon0") <= F.col("lon1"))
    packed = F.lit(0).cast("long")
    for n in sides:  # a side is within 2^15 cells of the equator or the meridian
        packed = packed * (1 << 16) + (F.col(n) + (1 << 14))
    return rows.select(key, F.when(full, packed).otherwise(F.lit(-1)).alias("box"), *(F.when(full, F.col(n)).alias(n) for n in sides))


def level(low: str, high: str) -> Column:
    """The greatest power of two that a side of a box holds, as its exponent."""
    return F.floor(F.log2(F.col(high) - F.col(low) + 1)).cast("int")


def corners(boxes: DataFrame, frame: dict[str, int]) -> DataFrame:
    """(box, lat_i, lon_i, sign, a, b): the cells to look up for every different box, at most eight.

    sign: what the prefix sum there counts; a, b: whether the block of 2^a x 2^b cells from there is asked
    for its extremes. The box without cells looks up one that counts nothing, so it is found too.
    """
    at = lambda lat, lon, sign, a, b: F.struct(lat.cast("int").alias("lat_i"), lon.cast("int").alias("lon_i"), F.lit(sign).alias("sign"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    no, (lat0, lat1, lon0, lon1) = F.lit(None), (F.col(c) for c in ("lat0", "lat1", "lon0", "lon1"))
    a, b = F.col("a"), F.col("b")
    far_lat, far_lon = lat1 - F.pow(F.lit(2), a) + 1, lon1 - F.pow(F.lit(2), b) + 1
    sums = (at(lat1, lon1, 1, no, no), at(lat0 - 1, lon1, -1, no, no), at(lat1, lon0 - 1, -1, no, no), at(lat0 - 1, lon0 - 1, 1, no, no))
    blocks = (at(x, y, 0, a, b) for x in (lat0, far_lat) for y in (lon0, far_lon))
    base = at(F.lit(frame["lat1"]), F.lit(frame["lon1"]), 0, no, no)
    rows = boxes.select("box", "lat0", "lat1", "lon0", "lon1").distinct().withColumns({"a": level("lat0", "lat1"), "b": level("lon0", "lon1")})
    rows = rows.select("box", F.explode(F.when(F.col("box") >= 0, F.array(*sums, *blocks)).otherwise(F.array(base))).alias("c")).select("box", "c.*")
    inside = rows.where((F.col("lat_i") >= frame["lat0"]) & (F.col("lon_i") >= frame["lon0"]))
    return inside.groupBy("box", "lat_i", "lon_i").agg(F.sum("sign").cast("int").alias("sign"), F.max("a").alias("a"), F.max("b").alias("b"))


def box_totals(maps: DataFrame, keys: list[str], sums: dict[str, Column], extremes: dict[str, Column], areas: DataFrame, key: str = "area_label", frame: dict[str, int] | None = None) -> DataFrame:
    """(keys, key, sums, <name>_min and <name>_max of extremes) for every map and area.

    maps: by_map rows with lat_i, lon_i; several rows of a cell are added up. sums must not be null. Areas
    may overlap; an area without cells has sums of 0 and null extremes; areas of one key count together, and
    areas that hold the same cells are looked up once.
    A map is as large as the frame of all maps (found in one pass, unless it is given), a bounded number of
    cells that one task sorts. Maps or areas without rows give none.
    """
    frame = frame or frame_of(maps)
    if frame is None:
        blank = maps.limit(0).select(*keys, *(c.alias(n) for n, c in sums.items()), *(c.alias(f"{n}_{k}") for n, c in extremes.items() for k in ("min", "max")))
        return blank.crossJoin(areas.limit(0).select(key)).select(*keys, key, *(c for c in blank.columns if c not in keys))
    boxes = cell_boxes(areas, frame, key)
    asked = corners(boxes, frame)
    levels = sorted((r["a"], r["b"]) for r in asked.where("a is not null").select("a", "b").distinct().collect()) if extremes else []  # at most log2 of height times log2 of width

    # every cell of the frame, once a map: the first row of a map brings those of no value
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("lat_i", "lon_i")) == 1
    span = lambda c: F.sequence(F.lit(frame[c + "0"]), F.lit(frame[c + "1"]))
    rows = maps.where(F.col("lat_i").isNotNull() & F.col("lon_i").isNotNull()).select(*keys, "lat_i", "lon_i", *(c.alias(n) for n, c in sums.items()), *(c.alias(f"_{n}") for n, c in extremes.items()), first.alias("_first"))
    kinds = dict(rows.dtypes)
    cell = lambda lat, lon, own: F.struct(lat.alias("lat_i"), lon.alias("lon_i"), *((F.col(n) if own else F.lit(0)).cast(kinds[n]).alias(n) for n in sums), *((F.col(f"_{n}") if own else F.lit(None)).cast(kinds[f"_{n}"]).alias(f"_{n}") for n in extremes))
    blank = F.flatten(F.transform(span("lat"), lambda lat: F.transform(span("lon"), lambda lon: cell(lat, lon, False))))
    own = F.array(cell(F.col("lat_i"), F.col("lon_i"), True))
    cells = rows.select(*keys, F.explode(F.when(F.col("_first"), F.concat(own, blank)).otherwise(own)).alias("c")).select(*keys, "c.*")
    cells = cells.groupBy(*keys, "lat_i", "lon_i").agg(*(F.sum(n).alias(n) for n in sums), *(f(f"_{n}").alias(f"_{n}_{k}_0_0") for n in extremes for k, f in (("min", F.min), ("max", F.max))))

    along_lon, along_lat = Window.partitionBy(*keys, "lat_i").orderBy("lon_i"), Window.partitionBy(*keys, "lon_i").orderBy("lat_i")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    joined = {"min": F.least, "max": F.greatest}
    wider = lambda old, w, steps, k: joined[k](F.col(old), F.lead(old, steps).over(w))
    names = [(n, k) for n in extremes for k in ("min", "max")]
    table = cells.withColumns({n: F.sum(n).over(so_far(along_lon)) for n in sums})
    for b in range(1, max((b for _, b in levels), default=0) + 1):
        table = table.withColumns({f"_{n}_{k}_0_{b}": wider(f"_{n}_{k}_0_{b - 1}", along_lon, 1 << (b - 1), k) for n, k in names})
    table = table.withColumns({n: F.sum(n).over(so_far(along_lat)) for n in sums})
    for a in range(1, max((a for a, _ in levels), default=0) + 1):
        own = sorted({b for x, b in levels if x >= a})
        table = table.withColumns({f"_{n}_{k}_{a}_{b}": wider(f"_{n}_{k}_{a - 1}_{b}", along_lat, 1 << (a - 1), k) for b in own for n, k in names})

    found = table.join(few(asked), ["lat_i", "lon_i"])
    of_level = lambda n, k: F.coalesce(*(F.when((F.col("a") == a) & (F.col("b") == b), F.col(f"_{n}_{k}_{a}_{b}")) for a, b in levels), F.lit(None).cast(kinds[f"_{n}"]))
    extreme = {"min": F.min, "max": F.max}
    totals = found.groupBy(*keys, "box").agg(*(F.sum(F.col(n) * F.col("sign")).cast(kinds[n]).alias(n) for n in sums), *(extreme[k](of_level(n, k)).alias(f"{n}_{k}") for n, k in names))
    told = totals.join(few(boxes.select(key, "box")), "box").drop("box")
    if areas.groupBy(key).count().where("count > 1").isEmpty():
        return told.select(*keys, key, *sums, *(f"{n}_{k}" for n, k in names))
    return told.groupBy(*keys, key).agg(*(F.sum(n).cast(kinds[n]).alias(n) for n in sums), *(extreme[k](f"{n}_{k}").alias(f"{n}_{k}") for n, k in names))


def metrics_of_totals() -> dict[str, Column]:
    """The continuous metrics from box_totals of pair_sums and pair_extremes.

    A sum is a difference of prefix sums, exact but for rounding, so what the extremes tell to be constant
    or zero is taken from them.
    """
    n = F.when(F.col("v") > 0, F.col("v").cast("double"))
    zero = lambda c: (F.col(f"{c}_min") == 0) & (F.col(f"{c}_max") == 0)
    total = lambda c, of: F.when(n.isNotNull(), F.when(zero(of), 0.0).otherwise(F.greatest(F.col(c), F.lit(0.0))))
    mean = lambda c: F.when(F.col(f"{c}_min") == F.col(f"{c}_max"), F.col(f"{c}_min")).otherwise(F.col(c) / n)
    mean_o = F.abs(mean("o"))
    mae, rmse = total("ad", "d") / n, F.sqrt(total("dd", "d") / n)
    # of values less their map's mean
    cov = F.col("po") / n - F.col("p1") / n * F.col("o1") / n
    spread = lambda c: F.greatest(F.col(f"{c}{c}") / n - (F.col(f"{c}1") / n) * (F.col(f"{c}1") / n), F.lit(0.0))
    varied = (F.col("p_max") > F.col("p_min")) & (F.col("o_max") > F.col("o_min"))
    corr = F.greatest(F.least(F.try_divide(cov, F.sqrt(spread("p") * spread("o"))), F.lit(1.0)), F.lit(-1.0))
    return {
        "cell_count": F.col("n"), "valid_cell_count": F.col("v"), "predicted_mean": mean("p"), "observed_mean": mean("o"), "mae": mae, "rmse": rmse, "bias": mean("d"),
        "correlation": F.when(varied, corr), "predicted_min": F.col("p_min"), "predicted_max": F.col("p_max"), "observed_min": F.col("o_min"), "observed_max": F.col("o_max"),
        "wape_pct": ratio(100.0 * total("ad", "d"), total("ao", "o"), EPS), "smape_pct": total("sm", "d") / n, "rmae_pct": ratio(100.0 * mae, mean_o, EPS), "cvrmse_pct": ratio(100.0 * rmse, mean_o, EPS),
    }


def area_metrics(pairs: DataFrame, areas: DataFrame, keys: list[str], key: str = "area_label", frame: dict[str, int] | None = None) -> DataFrame:
    """continuous_metrics of every map (keys) in every area, and of every whole map as area full_grid.

    Products are summed over values less their map's mean, so a small box of a large map keeps its digits.
    """
    maps = by_map(pairs.withColumns({"_p": finite("predicted"), "_o": finite("observed"), "_ok": valid_pair()}), keys)
    on = lambda x: F.when(F.col("_ok"), x).otherwise(F.lit(0.0))
    whole = Window.partitionBy(*keys)
    told = maps.withColumns({f"_m{c}": F.avg(F.when(F.col("_ok"), F.col(f"_{c}"))).over(whole) for c in "po"})
    p, o = F.col("_p"), F.col("_o")
    d, p1, o1, size = p - o, p - F.col("_mp"), o - F.col("_mo"), F.abs(p) + F.abs(o)
    sums = {"n": F.lit(1).cast("long"), "v": F.col("_ok").cast("long")}
    sums |= {c: on(x) for c, x in {"p": p, "o": o, "d": d, "ad": F.abs(d), "dd": d * d, "ao": F.abs(o), "p1": p1, "o1": o1, "pp": p1 * p1, "oo": o1 * o1, "po": p1 * o1, "sm": F.when(size > EPS, 200.0 * F.abs(d) / size).otherwise(0.0)}.items()}
    extremes = {c: F.when(F.col("_ok"), x) for c, x in {"p": p, "o": o, "d": d}.items()}
    totals = box_totals(told, keys, sums, extremes, areas, key, frame)
    full = continuous_metrics(maps, keys).withColumn(key, F.lit("full_grid"))
    return totals.select(*keys, key, *(c.alias(n) for n, c in metrics_of_totals().items())).unionByName(full)


def batch_areas(grid: DataFrame, areas: DataFrame, keys: list[str], key: str = "area_label", frame: dict[str, int] | None = None) -> DataFrame:
    """batch_area_summary of every area: means whose weights include cells without a value."""
    maps = by_map(cell_keys(grid), keys)
    w = F.col("latitude_weight")
    sums = {"cell_count": F.lit(1).cast("long"), "w": w}
    for c in ("t2m", "tp"):
        sums |= {c: F.coalesce(finite(c) * w, F.lit(0.0)), f"{c}_n": finite(c).isNotNull().cast("long")}
    totals = box_totals(maps, keys, sums, {}, areas, key, frame)
    mean = lambda c: F.when((F.col(f"{c}_n") > 0) & (F.col("cell_count") > 0), F.col(c) / F.col("w"))
    return totals.select(*keys, key, (mean("t2m") - 273.15).alias("temperature_mean_area_c"), (mean("tp") * 1000.0).alias("precipitation_mean_area_mm"), "cell_count")


def batch_species_areas(pairs: DataFrame, areas: DataFrame, keys: list[str], threshold: float = 0.5, key: str = "area_label", frame: dict[str, int] | None = None) -> DataFrame:
    """batch_species_summary of every area: species whose strongest signal there reaches the threshold."""
    one = [*keys, "species"]
    top = box_totals(by_map(pairs, one), one, {"n": F.lit(1).cast("long")}, {"signal": finite("predicted")}, areas, key, frame)
    return top.groupBy(*keys, key).agg(F.count_if(F.coalesce(F.col("signal_max") >= threshold, F.lit(False))).alias("species_count_area_proxy"), F.max("signal_max").alias("max_signal"))
