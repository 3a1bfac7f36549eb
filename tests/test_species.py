"""Many-area species counts against a test of every record, and the error of stored sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridjobs.operators import observed, species
from gridjobs.plans import catalog
from gridjobs.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def occ(spark):
    """Records inside, on and just outside of box sides, at cell corners, negative, null."""
    rng = random.Random(0)
    rows = []
    for _ in range(2500):
        lat, lon = rng.uniform(-3, 12), rng.uniform(-9, 9)
        lat, lon = rng.choice([(lat, lon), (round(lat * 4) / 4, lon), (lat, round(lon * 4) / 4), (round(lat * 4) / 4, round(lon * 4) / 4), (round(lat, 1), round(lon, 1))])
        rows.append((f"s{rng.randrange(12)}", lat, lon, datetime.datetime(2020, rng.randrange(1, 5), 3)))
    rows += [(None, 1.0, 1.0, rows[0][3]), ("s", None, 1.0, rows[0][3]), ("s", 1.0, None, rows[0][3]), ("s", 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "species string, latitude double, longitude double, ts timestamp").repartition(3)


BOXES = [("wide", -3.0, 12.0, -9.0, 9.0), ("inner", 0.1, 9.9, -6.3, 6.05), ("point", 1.0, 1.0, 1.0, 1.0), ("line", 0.5, 0.5, -9.0, 9.0), ("cell", 2.0, 2.2, 3.0, 3.1), ("turned", 5.0, 4.0, 0.0, 1.0), ("away", 50.0, 51.0, 0.0, 1.0), ("two", -1.0, 3.0, -2.0, 2.0), ("two", 2.0, 5.0, 0.0, 4.0), ("tenths", 0.1, 4.3, 0.3, 4.7)]


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(BOXES, "area_label string, min_lat double, max_lat double, min_lon double, max_lon double")


@pytest.mark.parametrize("block", [1, 3, 16])
def test_species_areas(occ, areas, block):
    got = {(r[0], r[1]): r[2] for r in species.species_areas(occ, areas, block=block).collect()}
    want = {}
    for r in occ.collect():
        for name, a, b, c, d in BOXES:
            if None not in tuple(r) and a <= r["latitude"] <= b and c <= r["longitude"] <= d:
                want.setdefault((name, r["ts"].date().replace(day=1)), set()).add(r["species"])
    assert got == {k: len(v) for k, v in want.items()} and len(got) >= 20


def test_boxes_are_covered_once(spark, areas):
    """No cell of a box is listed twice, and blocks are used where they fit."""
    wide = areas.where("area_label = 'wide'")
    cells = species.box_cells(wide, block=4)
    fine = cells.withColumns({"lat": F.when(F.col("size") == 1, F.array("lat_c")).otherwise(F.sequence(F.col("lat_c") * 4, F.col("lat_c") * 4 + 3)), "lon": F.when(F.col("size") == 1, F.array("lon_c")).otherwise(F.sequence(F.col("lon_c") * 4, F.col("lon_c") * 4 + 3))})
    fine = fine.select(F.explode("lat").alias("lat"), "lon", "edge").select("lat", F.explode("lon").alias("lon"), "edge")
    assert fine.count() == fine.select("lat", "lon").distinct().count() == 61 * 73
    assert fine.where("edge").count() == 2 * (61 + 73) - 4
    assert cells.count() < 61 * 73 / 4


def test_one_area_is_the_plain_count(occ, areas):
    for start, steps in ((None, None), ("2020-02-01", 2)):
        box = dict(zip(("min_lat", "max_lat", "min_lon", "max_lon"), BOXES[1][1:]))
        plain = observed.species_area_month(occ, box, start, start and "2020-04-01", steps)
        many = species.species_areas(occ, areas.where("area_label = 'inner'"), start, start and "2020-04-01", steps)
        assert sorted(tuple(r) for r in plain.collect()) == sorted((r["month"], r["species_count_observed_area"]) for r in many.collect())


def test_join_has_no_box_test_but_on_edges(occ, areas):
    plan = species.species_areas(occ, areas)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stored_sketches(spark, tmp_path):
    """The union of cells is the sketch of all records; the error is small; records are not read again."""
    rows = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id") % 9_000).alias("species"), (40 + F.col("id") % 7 / 4).alias("latitude"), (F.col("id") % 11 / 4).alias("longitude"), F.date_add(F.lit("2020-01-05").cast("date"), (F.col("id") % 300).cast("int")).cast("timestamp").alias("ts"))
    path = str(tmp_path / "sketches")
    made = species.species_sketches(rows)
    tables.write_sketches(made, path)
    tables.write_sketches(made.where("month = date '2020-03-01'"), path)  # a rerun of one month
    stored = tables.read_sketches(spark, path)
    assert stored.agg(F.sum("records")).first()[0] == 60_000
    area = spark.createDataFrame([("all", 0.0, 90.0, -1.0, 9.0), ("all", 40.0, 41.0, 0.0, 1.0), ("some", 40.0, 40.5, 0.0, 1.0), ("none", 0.0, 1.0, 0.0, 1.0)], "area_label string, min_lat double, max_lat double, min_lon double, max_lon double")
    told = {r["area_label"]: r for r in species.sketched_areas(stored, area, 12).collect()}
    # one stream and a union have different estimators of the same registers: three standard errors apart at most
    one = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("species", F.lit(species.SKETCH))).alias("n")).first()["n"]
    assert told["all"]["records"] == 60_000 and abs(told["all"]["species_estimate"] - one) <= 0.049 * one
    assert abs(told["all"]["species_estimate"] - 9_000) < 0.06 * 9_000 and "none" not in told
    exact = rows.where("latitude <= 40.5 and longitude <= 1").select("species").distinct().count()
    assert abs(told["some"]["species_estimate"] - exact) < 0.06 * exact
    march = tables.read_sketches(spark, path, "2020-03-01", "2020-03-31")
    assert march.select("month").distinct().count() == 1 and "PartitionFilters: [isnotnull(month" in march._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="divide"):
        species.sketched_areas(stored, area, 5)


def test_sketched_query_error(spark):
    f = catalog.Fixtures(spark, DATA)
    areas = f.areas.withColumns({c: F.col(c) - 3 for c in ("min_lon", "max_lon")})
    exact = {}
    for r in species.sketched_areas(species.species_sketches(f.occ), areas, 12).collect():
        exact[r["area_label"], r["period"].year] = r["species_estimate"]
    cells = species.areas_range_join(species.snap_to_grid(f.occ), areas).groupBy("area_label", F.year("ts").alias("y")).agg(F.countDistinct("species").alias("n"))
    rows = cells.collect()
    assert len(rows) == len(exact) > 0 and all(abs(exact[r["area_label"], r["y"]] - r["n"]) <= 1 for r in rows)
