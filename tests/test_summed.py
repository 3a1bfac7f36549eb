"""Summed-area tables against joins of all cells."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridjobs.functions.grid import areas_range_join
from gridjobs.operators import observed, summed
from gridjobs.operators.metrics import continuous_metrics
from gridjobs.plans import catalog
from tests.compare import rows

KEYS = ["run", "grp", "variable"]
METRICS = ("predicted_mean", "observed_mean", "mae", "rmse", "bias", "correlation", "predicted_min", "predicted_max", "observed_min", "observed_max", "wape_pct", "smape_pct", "rmae_pct", "cvrmse_pct")


@pytest.fixture(scope="module")
def pairs(spark):
    """Maps with holes, doubled cells, nulls, infinities, constants, zeros, a Kelvin map, a null key."""
    rng = random.Random(1)
    out = []
    for run, grp, variable in (("a", "climate", "t2m"), ("a", "vegetation", "NDVI"), ("b", "land", "Land"), ("b", "climate", "tp"), (None, "climate", "t2m"), ("c", "empty", "none")):
        for i in range(160, 173):
            for j in range(-9, 12):
                if rng.random() < 0.2 or (run is None and i > 164):
                    continue
                base = 280 if variable == "t2m" else 0
                p, o = base + rng.random() * 3, base + rng.random() * 3
                if variable == "Land":
                    o = 7.0 if j < 0 else 0.0
                    p = o if i < 166 else p
                if variable == "none" or rng.random() < 0.1:
                    o = rng.choice([None, float("nan"), float("inf")])
                if variable == "NDVI" and rng.random() < 0.3:
                    o = 0.0
                out.append((run, grp, variable, i, j, i / 4, j / 4, p, o))
                if rng.random() < 0.1:
                    out.append((run, grp, variable, i, j, i / 4, j / 4, p + 1, o))
    return spark.createDataFrame(out, "run string, grp string, variable string, lat_i int, lon_i int, latitude double, longitude double, predicted double, observed double")


@pytest.fixture(scope="module")
def areas(spark):
    rng = random.Random(2)
    out = [("all", 0.0, 90.0, -90.0, 90.0), ("none", 10.0, 11.0, 0.0, 1.0), ("inside a cell", 40.3, 40.4, 0.1, 0.2), ("one cell", 40.5, 40.5, 0.25, 0.25), ("edge", 42.9, 50.0, 2.6, 9.0), ("turned", 42.0, 41.0, 0.0, 1.0), ("twice", 40.0, 40.5, 0.0, 0.5), ("twice", 40.25, 41.0, 0.0, 0.5), ("zero", 40.0, 43.0, 0.0, 2.0), ("seven", 40.0, 43.0, -2.0, -0.25)]
    for k in range(25):
        lat, lon = rng.uniform(39, 43), rng.uniform(-3, 3)
        out.append((f"r{k}", lat, lat + rng.random() * 2, lon, lon + rng.random() * 4))
    return spark.createDataFrame(out, "area_label string, min_lat double, max_lat double, min_lon double, max_lon double")


def test_area_metrics_equal_the_join_of_all_cells(pairs, areas):
    got = summed.area_metrics(pairs, areas, KEYS)
    own = continuous_metrics(areas_range_join(pairs, areas), [*KEYS, "area_label"])
    frame = areas.select("area_label").distinct().crossJoin(pairs.select(*KEYS).distinct())
    own = frame.alias("f").join(own.alias("o"), F.expr(" and ".join(f"f.{k} <=> o.{k}" for k in [*KEYS, "area_label"])), "left").select(*(f"f.{k}" for k in [*KEYS, "area_label"]), *(f"o.{c}" for c in ("cell_count", "valid_cell_count", *METRICS))).fillna(0, ["cell_count", "valid_cell_count"])
    want = own.unionByName(continuous_metrics(pairs, KEYS).withColumn("area_label", F.lit("full_grid")))
    told = [df.withColumns({c: F.round(c, 6) + 0.0 for c in METRICS}).toPandas() for df in (got, want)]
    x, y = map(rows, told)
    assert len(x) == len(y) == 6 * 34 + 6
    assert x == y, [(i, j) for i, j in zip(x, y) if i != j][:2]


def test_cells_meet_areas_at_corners_only(spark, pairs, areas):
    """One shuffle of the cells, and the join has a few rows for each area."""
    plan = summed.area_metrics(pairs, areas, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("REPARTITION_BY_NUM", plan)) == 2  # one for the tables and, the same exchange, one for whole maps
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    frame = {"lat0": 160, "lat1": 172, "lon0": -9, "lon1": 11}
    boxes = summed.cell_boxes(areas, frame, "area_label")
    asked = summed.corners(boxes, frame)
    assert asked.count() <= 8 * boxes.select("box").distinct().count() and boxes.where("box = -1").count() >= 3


def test_species_areas(spark, areas):
    rng = random.Random(3)
    data = [(m, f"s{s}", i, j, rng.random() if rng.random() > 0.2 else None) for m in "xy" for s in range(4) for i in range(160, 168) for j in range(0, 9) if rng.random() > 0.3]
    pairs = spark.createDataFrame(data, "month string, species string, lat_i int, lon_i int, predicted double")
    got = {(r["month"], r["area_label"]): (r["species_count_area_proxy"], r["max_signal"]) for r in summed.batch_species_areas(pairs, areas, ["month"], 0.9).collect()}
    for a in areas.where("area_label like 'r%'").collect():
        for m in "xy":
            tops = {}
            for k, s, i, j, v in data:
                if k == m and v is not None and a["min_lat"] <= i / 4 <= a["max_lat"] and a["min_lon"] <= j / 4 <= a["max_lon"]:
                    tops[s] = max(v, tops.get(s, v))
            assert got[m, a["area_label"]] == (sum(v >= 0.9 for v in tops.values()), max(tops.values(), default=None))


def test_empty_tables(pairs, areas):
    assert summed.area_metrics(pairs.limit(0), areas, KEYS).count() == 0
    assert summed.area_metrics(pairs, areas.limit(0), KEYS).count() == 6


def test_batch_areas_of_the_whole_grid_is_the_summary(spark):
    f = catalog.Fixtures(spark, "/root/testdata/sf0.001")
    one = spark.createDataFrame([("all", 0.0, 90.0, -180.0, 180.0)], "area_label string, min_lat double, max_lat double, min_lon double, max_lon double")
    got = summed.batch_areas(f.grid_obs, one, ["month"]).drop("area_label")
    want = observed.batch_area_summary(f.grid_obs, ["month"])
    cut = lambda df: rows(df.withColumns({c: F.round(c, 6) for c in ("temperature_mean_area_c", "precipitation_mean_area_mm")}).toPandas())
    assert cut(got) == cut(want)
