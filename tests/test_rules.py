"""Numeric examples and rules on tiny tables."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.functions import grid, months, text, values
from gridjobs.operators import cities, landcover, metrics, observed, quality, reshape, trends, verify
from gridjobs.plans.fixtures import Fixtures


def pairs(spark, predicted, observed_, group="vegetation", variable="NDVI"):
    rows = [("r", group, variable, i, float(p) if p is not None else None, float(o) if o is not None else None) for i, (p, o) in enumerate(zip(predicted, observed_))]
    return spark.createDataFrame(rows, "run_id string, grp string, variable string, cell int, predicted double, observed double")


def test_ndvi_leaves_observed_zeros_out(spark):
    r = metrics.continuous_metrics(pairs(spark, [2, 4, 0, 8], [1, 2, 0, 4]), ["run_id"]).first()
    assert (r["cell_count"], r["valid_cell_count"]) == (4, 3)
    assert r["mae"] == pytest.approx(7 / 3) and r["wape_pct"] == pytest.approx(100) and r["smape_pct"] == pytest.approx(200 / 3)


def test_other_variables_keep_zeros(spark):
    r = metrics.continuous_metrics(pairs(spark, [2, 4, 0, 8], [1, 2, 0, 4], "climate", "tp"), ["run_id"]).first()
    assert r["valid_cell_count"] == 4 and r["wape_pct"] == pytest.approx(100) and r["smape_pct"] == pytest.approx(50)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    p, o = rng.normal(size=300), rng.normal(size=300)
    p[:7], o[5:11] = np.nan, np.inf
    r = metrics.continuous_metrics(pairs(spark, p, o, "climate", "t2m"), ["run_id"]).first()
    ok = np.isfinite(p) & np.isfinite(o)
    p, o = p[ok], o[ok]
    d = p - o
    assert r["valid_cell_count"] == ok.sum()
    for name, want in {"mae": abs(d).mean(), "rmse": math.sqrt((d * d).mean()), "bias": d.mean(), "correlation": np.corrcoef(p, o)[0, 1], "wape_pct": 100 * abs(d).sum() / abs(o).sum(), "cvrmse_pct": 100 * math.sqrt((d * d).mean()) / abs(o.mean())}.items():
        assert r[name] == pytest.approx(want), name


def test_constant_and_empty_groups(spark):
    r = metrics.continuous_metrics(pairs(spark, [1, 2, 3], [5, 5, 5], "land", "Land"), ["run_id"]).first()
    assert r["correlation"] is None and r["mae"] == pytest.approx(3)
    r = metrics.continuous_metrics(pairs(spark, [None, 2], [5, None]), ["run_id"]).first()
    assert r["valid_cell_count"] == 0 and r["mae"] is None and r["wape_pct"] is None


def test_wape_contributions_sum_to_wape(spark):
    rows = metrics.cell_metrics(pairs(spark, [1, 2, 3, 4], [2, 2, 5, 1], "climate", "tp"), ["run_id"]).collect()
    assert sum(r["wape_contribution_pct"] for r in rows) == pytest.approx(rows[0]["wape_pct"])


def test_binary_counts_cover_all_rows(spark):
    r = metrics.binary_scores(pairs(spark, [0.6, 0.2, None, 0.7], [0.5, 0.9, 0.1, None], "species", "a"), ["run_id"], 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["f1_score"] == pytest.approx(0.5)


def test_snap_rounds_halves_to_even_and_is_idempotent(spark):
    df = spark.createDataFrame([(40.125, -0.125), (40.375, 0.1), (-0.1, 3.0)], "latitude double, longitude double")
    once = grid.snap_to_grid(df)
    assert [tuple(r) for r in once.select("latitude", "longitude").collect()] == [(40.0, 0.0), (40.5, 0.0), (0.0, 3.0)]
    assert grid.snap_to_grid(once).collect() == once.collect()
    assert grid.cell_keys(once).select("cell_id").first()[0] == "40.00_0.00"


def test_box_filters_after_snapping_for_cells_and_before_for_areas(spark):
    occ = spark.createDataFrame([("a", 40.1, 0.0, datetime.datetime(2020, 5, 3)), ("b", 39.9, 0.0, datetime.datetime(2020, 5, 4)), ("a", 40.12, 0.0, datetime.datetime(2020, 5, 9))], "species string, latitude double, longitude double, ts timestamp")
    box = {"min_lat": 40.0, "max_lat": 40.05, "min_lon": -1.0, "max_lon": 1.0}
    assert [r["species_count"] for r in observed.species_cell_month(occ, box).collect()] == [2]
    assert observed.species_area_month(occ, box).count() == 0


def test_flip_twice_is_identity(spark):
    df = spark.range(12).select((F.col("id") % 3).cast("int").alias("lat_index"), (F.col("id") % 4).cast("int").alias("lon_index"))
    twice = grid.flip(grid.flip(df, True, True, 3, 4), True, True, 3, 4)
    assert sorted(twice.collect()) == sorted(df.collect())


def test_runs_are_turned_as_their_manifests_say(spark):
    cells = [(r, "t2m", y, x, float(10 * y + x)) for r in "abc" for y in (0, 1) for x in (0, 1)]
    maps = spark.createDataFrame(cells, "run_id string, variable string, lat_index int, lon_index int, predicted double").withColumn("observed", F.col("predicted"))
    runs = spark.createDataFrame([("a", True, True), ("b", None, None)], "run_id string, latitude_flip boolean, longitude_flip boolean")
    at = lambda **k: {r["run_id"]: r["observed"] for r in verify.pair_runs(maps, maps, runs, ["variable"], size=(2, 2), **k).where("predicted = 0").collect()}
    assert at() == {"a": 11.0, "b": 0.0, "c": 0.0} and at(export=True) == {"a": 11.0, "b": 10.0, "c": 10.0}


def test_greenness_without_leaf_area_is_zero_on_land_and_missing_at_sea(spark):
    df = spark.createDataFrame([(None, None, True), (None, None, None), (2.0, None, True), (90.0, 9.0, True), (1.0, 1.0, False)], "lai_hv double, lai_lv double, land boolean")
    got = [r[0] for r in df.select(observed.ndvi_from_lai(land="land")).collect()]
    assert got == [0.0, None, pytest.approx(1 - math.exp(-1)), 0.92, None]


def test_first_of_equal_steps_does_not_depend_on_order(spark):
    rows = [("t", "2020-01", 1, 1, 5, v) for v in (3.0, 1.0, 2.0)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "variable string, month string, lat_i int, lon_i int, valid_time int, value double")
        assert [r["value"] for r in observed.first_matching_step(df).collect()] == [1.0]


def test_approximate_counts_stay_near(spark):
    f = Fixtures(spark, "/root/testdata/sf0.01")
    one, two = (observed.species_cell_month(f.occ, approximate=a).toPandas().set_index(["month", "lat_i", "lon_i"])["species_count"] for a in (False, True))
    two = two.reindex(one.index)
    assert two.notna().all() and ((one - two).abs() <= 1 + 0.15 * one).all()


def test_sorted_metrics_put_missing_levels_where_asked(spark):
    df = spark.createDataFrame([("b", "g", "v", 1), ("a", "g", "v", 2), ("a", "g", "v", None)], "forecast_month string, grp string, variable string, level int")
    order = lambda first: [(r["forecast_month"], r["level"]) for r in metrics.sort_metrics(df, first).collect()]
    assert order(True) == [("a", None), ("a", 2), ("b", 1)] and order(False) == [("a", 2), ("a", None), ("b", 1)]


def test_catalogs_are_sorted_without_ties(spark):
    rows = [("b", "B", "X", 5), ("a2", "A", "X", 5), ("a1", "A", "X", 5), ("c", "C", "W", 5), ("d", "D", "Z", 9), ("e", "E", "Z", None)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "value string, label string, country string, population long")
        assert [r["value"] for r in cities.sort_catalog(df).collect()] == ["d", "c", "a1", "a2", "b", "e"]


def test_maps_without_a_target_can_be_kept(spark):
    one = spark.createDataFrame([("v", 0, 0, 1.0), ("v", 0, 1, 2.0)], "variable string, lat_index int, lon_index int, predicted double")
    two = spark.createDataFrame([("v", 0, 0, 3.0)], "variable string, lat_index int, lon_index int, observed double")
    pairs_of = lambda keep: sorted((r["lon_index"], r["observed"] or 0) for r in verify.pair_maps(one, two, ["variable"], size=(1, 2), keep_unmatched=keep).collect())
    assert pairs_of(False) == [(0, 3.0)] and pairs_of(True) == [(0, 3.0), (1, 0)]


def test_validation_summary_without_cases(spark):
    cases = Fixtures(spark, "/root/testdata/sf0.001").cases
    told = verify.validation_summary(verify.case_validation(cases.limit(0))).first()
    assert (told["case_count"], told["overall_pass_rate_pct"], told["species_mean_error_pct_proxy"]) == (0, 0.0, 0.0)


def counted(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("Relation "), physical.count("BroadcastNestedLoopJoin") + physical.count("CartesianProduct")


def test_plans_stay_small(spark):
    from gridjobs.plans import catalog

    build = catalog.queries()
    for name, scans, loops in (("cell_month", 8, 1), ("area_month", 9, 1), ("cell_metrics", 2, 0), ("species_richness", 1, 0), ("species_matrix", 1, 0)):
        told = counted(build[name](spark, "/root/testdata/sf0.001"))
        assert told[0] <= scans and told[1] <= loops, (name, told)


def test_model_domain_leaves_out_its_edges(spark):
    cells = grid.grid_cells(spark)
    assert cells.count() == 160 * 280
    r = cells.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    assert tuple(r) == (32.25, 72.0, -25.0, 44.75)


def test_padding_only_where_a_box_is_empty(spark):
    cells = spark.createDataFrame([(40.0, 0.0), (40.25, 0.0)], "latitude double, longitude double")
    areas = spark.createDataFrame([("in", 39.9, 40.1, -0.1, 0.1), ("near", 40.05, 40.07, -0.1, 0.1), ("far", 50.0, 50.1, 0.0, 1.0)], "area_label string, min_lat double, max_lat double, min_lon double, max_lon double")
    got = {(r["area_label"], r["latitude"]) for r in grid.select_bbox(cells, areas).collect()}
    assert got == {("in", 40.0), ("near", 40.0)}


def test_padded_boxes_of_all_areas_meet_by_cell_keys(spark):
    f = Fixtures(spark, "/root/testdata/sf0.01")
    off = spark.createDataFrame([(40.125, 0.375), (40.3751, 0.1), (41.07, 0.62), (None, 0.5)], "latitude double, longitude double")
    cells = f.grid_obs.select("latitude", "longitude").distinct().union(off)
    out = grid.select_bbox(cells, f.areas.hint("merge"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    at, want = [tuple(r) for r in cells.dropna().collect()], []
    areas = f.areas.collect()
    for a in areas:
        by = {p: [x for x in at if a["min_lat"] - p <= x[0] <= a["max_lat"] + p and a["min_lon"] - p <= x[1] <= a["max_lon"] + p] for p in (0, 0.125)}
        want += [(a["area_label"], *x) for x in by[0] or by[0.125]]
    assert len(areas) == 100 and sorted(map(tuple, out.select("area_label", "latitude", "longitude").collect())) == sorted(want)


def test_forecast_months(spark):
    df = spark.createDataFrame([("2021-04-01", "2021-05-01", "2021-12-01"), ("2021-11-01", "2021-12-01", "2021-12-01"), ("2021-05-01", "2021-05-01", "2021-12-01")], "s string, e string, l string")
    told = months.forecast_month(*(F.col(c).cast("date") for c in "sel"))
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in told.items())).collect()]
    assert got == [(datetime.date(2021, 6, 1), True), (datetime.date(2022, 1, 1), False), (None, False)]


@pytest.mark.parametrize(("name", "want"), [("NDVI_06/2019", (2019, 6)), ("ndvi_2019-06", (2019, 6)), ("NDVI_201906", (2019, 6)), ("2019_6_NDVI", (2019, 6)), ("NDVI_Jun_2019", (2019, 6)), ("ndvi062019", (2019, 6)), ("Latitude", None), ("NDVI_13/2019", None)])
def test_month_columns(name, want):
    got = reshape.month_of_column(name, "NDVI")
    assert (got and (got.year, got.month)) == want


def test_missing_month_column_is_named():
    with pytest.raises(KeyError, match="2019-06"):
        reshape.find_monthly_column(["Latitude", "NDVI_05/2019"], "NDVI", datetime.date(2019, 6, 1))
    assert reshape.find_monthly_column(["ndvi_2019-06"], "NDVI", datetime.date(2019, 6, 1)) == "ndvi_2019-06"


def test_month_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("5", "Mag", "Sept", "13", "x", None, "7.0", "december")], "m string")
    assert [r[0] for r in df.select(months.month_number("m")).collect()] == [5, 5, 9, None, None, None, 7, 12]


def test_carry_forward(spark):
    land = spark.createDataFrame([(0.0, 0.0, "a", 2022, 1.0), (0.0, 0.0, "a", 2023, 2.0), (0.0, 1.0, "a", 2023, None), (0.0, 0.0, "a", 2024, 9.0)], "latitude double, longitude double, variable string, year int, value double")
    years = spark.createDataFrame([(2023,), (2024,), (2025,)], "year int")
    kept = {(r["longitude"], r["year"]): (r["value"], r["mode"], r["source_year"]) for r in landcover.carry_forward(land, years).collect()}
    assert kept[0.0, 2024] == (9.0, "official", 2024) and kept[0.0, 2025] == (2.0, "carry_forward", 2023) and kept[1.0, 2025] == (None, "carry_forward", 2023)
    over = {(r["longitude"], r["year"]): r["value"] for r in landcover.carry_forward(land, years, overwrite=True).collect()}
    assert over[0.0, 2024] == 2.0 and over[0.0, 2025] == 2.0


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "k int, value double")
    b = spark.createDataFrame([(2, 7.0), (3, 1.0), (1, 6.0)], "k int, value double")
    for overwrite in (True, False):
        once = landcover.upsert_year(a, b, ["k"], overwrite)
        assert sorted(landcover.upsert_year(once, b, ["k"], overwrite).collect()) == sorted(once.collect())
    assert dict(landcover.upsert_year(a, b, ["k"], False).collect()) == {1: 5.0, 2: 7.0, 3: 1.0}


def test_later_tile_wins_where_it_has_data(spark):
    px = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 0.0, 0.05, 30.0), (2, 0.05, 0.0, 50.0), (3, 0.0, 0.0, None), (1, 1.0, 1.0, 4.0)], "tile_seq int, latitude double, longitude double, value double")
    assert {(r["lat_i"], r["value"]) for r in landcover.regrid_pixels(px).collect()} == {(0, 40.0), (4, 4.0)}


def test_slope_counts_positions_of_missing_rows(spark):
    rows = [("a", datetime.date(2020, m, 1), None if m == 2 else float(m)) for m in (1, 2, 3, 4)] + [("b", datetime.date(2020, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "area string, month date, t double")
    assert dict(trends.linear_slope(df, "t", ["area"]).collect()) == {"a": pytest.approx(1.0), "b": None}


def test_scale_and_back(spark):
    df = spark.createDataFrame([("t", None, 3.0), ("q", 850, 2.0), ("x", None, 7.0)], "variable string, level int, value double")
    stats = spark.createDataFrame([("t", None, 1.0, 5.0, 2.0, 4.0), ("q", 850, 2.0, 2.0, 0.0, 0.0)], "variable string, level int, stat_min double, stat_max double, stat_mean double, stat_std double")
    for mode in ("minmax", "zscore"):
        back = quality.scale(quality.scale(df, stats, mode), stats, mode, inverse=True)
        assert {(r["variable"], r["value"]) for r in back.collect()} == {("t", 3.0), ("q", 2.0), ("x", 7.0)}


def test_kelvin_guard(spark):
    df = spark.createDataFrame([("2020-01-01", "temperature", "predicted_t", 280.0), ("2020-01-01", "stl1", "predicted_stl1_native", 20.0), ("2020-01-01", "stl2", "predicted_stl2", 20.0), ("2020-01-01", "ndvi", "predicted_ndvi_native", 300.0)], "month string, variable string, column_name string, value double")
    got = {r["variable"]: round(r["value"], 2) for r in quality.kelvin_guard(df).collect()}
    assert got == {"temperature": 6.85, "stl1": -253.15, "stl2": 20.0, "ndvi": 300.0}


def test_grades_with_missing_metrics(spark):
    df = spark.createDataFrame([("climate", "t2m", 1.5, 0.2, 0.95, 5.0), ("climate", "t2m", None, None, None, None), ("forest", "Forest", 9.0, 1.0, 0.71, 80.0), ("x", "y", 1.0, 1.0, None, 1.0)], "grp string, variable string, mae double, bias double, correlation double, rmae_pct double")
    got = [tuple(r) for r in df.select(verify.reliability(), verify.readiness()).collect()]
    assert got == [("alta", "ready_high"), ("bassa", "needs_calibration"), ("media", "context_spatially_consistent"), ("bassa/diagnostica", "native_metric_only")]


def test_metadata_falls_back(spark):
    df = spark.createDataFrame([("climate", "t2m"), ("species", "9"), ("z", "z")], "grp string, variable string")
    got = {r["grp"]: r["domain"] for r in verify.attach_metadata(df).collect()}
    assert got == {"climate": "temperature_stress", "species": "species_distribution_proxy", "z": "native_model_variable"}


def test_names(spark):
    df = spark.createDataFrame([(" São Paulo! ", "°C", "a; b,,c"), ("__", "mm/month", "")], "n string, u string, l string")
    got = [tuple(r) for r in df.select(text.slugify("n"), text.unit_token("u"), text.city_key("n"), text.split_list("l")).collect()]
    assert got == [("s_o_paulo", "c", "sao paulo", ["a", "b", "c"]), ("selected_area", "mm_per_month", "", [])]


def test_percent_errors(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (3.0, 2.0), (None, 1.0)], "p double, o double")
    assert [r[0] for r in df.select(values.pct_error("p", "o")).collect()] == [0.0, 100.0, 50.0, None]


def test_two_weighted_means(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (4.0, 1.0)], "v double, latitude_weight double")
    assert df.agg(observed.weighted_mean("v")).first()[0] == pytest.approx(2.0)
    assert df.agg(observed.weighted_mean(F.lit(None).cast("double"))).first()[0] is None


def test_lists_of_cities(spark):
    from gridjobs.functions import text

    rows = [(" Milan, Rome;Paris ",), (",;, ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(text.split_list("c")).collect()]
    assert got == [["Milan", "Rome", "Paris"], [], [], None]
