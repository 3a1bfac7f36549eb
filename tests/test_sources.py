import datetime
import json

import pytest
from pyspark.sql import functions as F

from gridjobs.sources import tables


def test_json_dimensions_need_their_keys(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"city": "A", "start": "2020-01", "end": "2020-02"}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"city": "A", "start": "2020-01", "end": "2020-02"}, {"city": "B", "start": "2020-01"}]))
    (tmp_path / "areas.json").write_text(json.dumps([{"label": "x", "min_lat": 1, "max_lat": 2, "min_lon": 3, "max_lon": 4}]))
    assert [r["city"] for r in tables.read_cases(spark, str(tmp_path / "cases.json")).collect()] == ["A"]
    with pytest.raises(Exception, match="lacks end"):
        tables.read_cases(spark, str(tmp_path / "bad.json")).collect()
    assert tables.read_areas(spark, str(tmp_path / "areas.json")).first()["max_lon"] == 4.0


def test_occurrences_push_filters_down(spark, tmp_path):
    rows = [("s", 40.0, 1.0, datetime.datetime(2020, m, 15), "x") for m in (1, 2, 3)]
    spark.createDataFrame(rows, "Species string, Latitude double, Longitude double, Timestamp timestamp_ntz, Other string").write.parquet(str(tmp_path / "occ"))
    got = tables.read_occurrences(spark, str(tmp_path / "occ"), "2020-01-01", "2020-02-01", {"min_lat": 30, "max_lat": 50, "min_lon": 0, "max_lon": 2})
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Timestamp" in plan and "Other" not in plan


def test_spatial_csv_and_monthly_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Country,LAT,lon,NDVI_11/2020,NDVI_12/2020\nA,40.1,1.0,0.5,bad\nB,x,2,1,1\n")
    df = tables.read_spatial_table(spark, str(tmp_path / "t.csv"))
    from gridjobs.operators import reshape

    got = {(str(r["month"]), r["value"]) for r in reshape.monthly_wide_to_long(df, "NDVI", ["lat_i", "lon_i"]).collect()}
    assert got == {("2020-11-01", 0.5), ("2020-12-01", None)}


def test_publish_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("2020-01", "t", 1.0), ("2020-02", "t", 2.0)], "month string, variable string, value double")
    tables.publish_forecast_month(df, path, ["t", "tp"])
    steps = {r["month"]: (r["rollout_step_index"], r["rollout_steps_total"]) for r in tables.publish_forecast_month(df, path, ["t"]).collect()}
    assert steps == {"2020-01": (1, 2), "2020-02": (2, 2)}
    told = tables.publish_forecast_month(df.where("month = '2020-02'").withColumn("value", F.lit(9.0)), path, ["t", "tp"])
    assert told.first()["missing_features"] == ["tp"]
    assert {(r["month"], r["value"]) for r in spark.read.parquet(path).select(F.col("month").cast("string"), "value").collect()} == {("2020-01", 1.0), ("2020-02", 9.0)}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.createDataFrame([("2020-01-01", 1.5, 3)], "month string, temperature_mean_area_c double, cell_count_land int")
    tables.write_csv(df, path)
    r = tables.read_area_month(spark, path).first()
    assert (str(r["month"]), r["temperature_mean_area_c"], r["cell_count_land"]) == ("2020-01-01", 1.5, 3)
    tables.write_csv(df, path, comma=True)
    assert "1,5" in spark.read.text(path).where("value like '2020%'").first()[0]
    box = {"min_lat": 1.0, "max_lat": 2.0, "min_lon": 3.0, "max_lon": 4.0}
    tables.write_summary_json(df, str(tmp_path / "s"), "x", "city", box, {"temperature": "t.nc"}, cell_rows=7)
    told = spark.read.json(str(tmp_path / "s")).first()
    assert told["months"] == 1 and told["bounds"].asDict() == box and told["temperature_source"] == "t.nc" and told["cell_rows"] == 7 and "species_note" in told
    tables.write_summary_json(df, str(tmp_path / "r"), "x", "city", requested=("2019-12", "2020-02"), precipitation="tp")
    told = spark.read.json(str(tmp_path / "r")).first()
    assert (told["requested_start"], told["requested_end"]) == ("2019-12", "2020-02") and told["precipitation_conversion"].startswith("metres")
    texts = spark.createDataFrame([(tables.bounds_to_json(box),), ('{"min_lat": 1}',), ("x",)], "j string")
    assert [r[0] and r[0].asDict() for r in texts.select(tables.bounds_from_json("j")).collect()] == [box, None, None]


def test_each_forecast_layer_has_its_own_column(spark, tmp_path):
    path = str(tmp_path / "layers")
    spark.createDataFrame([("2020-01", "t", 40.0, 1.0, "280", None), ("2020-01", "s", 40.0, 1.0, None, "0.5"), ("2020-02", "t", 40.0, 1.0, "x", None)], "month string, variable string, Lat double, LON double, predicted_t_native string, predicted_s string").write.parquet(path)
    got = {(r["month"], r["variable"]): (r["column_name"], r["value"]) for r in tables.read_forecast_layers(spark, path, ["2020-01", "2020-02"]).collect()}
    assert got == {("2020-01", "t"): ("predicted_t_native", 280.0), ("2020-01", "s"): ("predicted_s", 0.5), ("2020-02", "t"): ("predicted_t_native", None)}


def test_manifests_tell_or_lack_their_orientation(spark, tmp_path):
    told = {"a": {"run": "a", "spatial_alignment": {"prediction_latitude_flip_applied": False}}, "b": {"run": "b"}, "c": {"run": "c", "spatial_alignment": {"prediction_longitude_flip_applied": True}}}
    for name, manifest in told.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_text(json.dumps(manifest))
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "m.json").write_text(json.dumps({"run": "d"}))
    got = {r["run"]: (r["latitude_flip"], r["longitude_flip"]) for r in tables.read_run_manifests(spark, str(tmp_path)).collect()}
    assert got == {"a": (False, None), "b": (True, False), "c": (None, True)}


def test_grid_and_pixel_readers(spark, tmp_path):
    grid, pixels = str(tmp_path / "g"), str(tmp_path / "p")
    rows = [("t2m", datetime.date(2020, m, 1), lat, 0.0, 1.0) for m in (1, 2) for lat in (30.0, 32.0, 40.0)] + [("tp", datetime.date(2020, 1, 1), 40.0, 0.0, 2.0)]
    spark.createDataFrame(rows, "variable string, month date, latitude double, longitude double, value double").write.partitionBy("variable").parquet(grid)
    read = lambda **k: tables.read_grid_long(spark, grid, ["t2m"], "2020-01-01", "2020-01-01", **k).count()
    assert (read(), read(model=False), read(model=True)) == (3, 3, 1)
    spark.createDataFrame([(1, "a", 0.0, 0.0, 5.0, 255.0, "x")], "tile_seq int, tile string, latitude double, longitude double, value double, nodata double, other string").write.parquet(pixels)
    assert tables.read_pixels(spark, pixels).columns == ["tile_seq", "tile", "latitude", "longitude", "value", "nodata"]


def test_manifests_of_conflicting_types(spark, tmp_path):
    """No schema is inferred: manifests that disagree on types, nest otherwise or are broken are all read."""
    told = {
        "a": {"run": "a", "bounds": {"min_lat": 1, "max_lat": 2, "min_lon": 3.5, "max_lon": 4}, "input_months": ["2020-01", "2020-02"], "group_source_status": {"surface": "real"}, "spatial_alignment": {"prediction_latitude_flip_applied": "false"}},
        "b": {"run": 7, "bounds": "[1, 2]", "input_months": "2020-01", "group_source_status": ["x"], "spatial_alignment": None, "label": {"deep": 1}},
    }
    for name, manifest in told.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_text(json.dumps(manifest, indent=1))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "published").mkdir()
    (tmp_path / "published" / "m.json").write_text("{}")
    df = tables.read_run_manifests(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 2)[1] if "c.json" not in r["path"] else "c": r for r in df.collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = (got[k] for k in "abc")
    assert (a["run"], a["input_months"], a["group_source_status"], a["bounds"]["min_lon"], a["latitude_flip"], a["longitude_flip"]) == ("a", ["2020-01", "2020-02"], {"surface": "real"}, 3.5, False, None)
    assert (b["run"], b["bounds"], b["group_source_status"], b["latitude_flip"], b["longitude_flip"]) == ("7", None, None, True, False)
    assert c["manifest"] is None and c["run"] is None and c["latitude_flip"] is None
    assert df.select(F.try_variant_get("manifest", "$.label.deep", "int").alias("d")).where("d = 1").count() == 1


def test_publication_keeps_its_manifest(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("2020-01", "t", 1.0), ("2020-02", "t", 2.0)], "month string, variable string, value double")
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (calls.add(1), v)[1], "double").asNondeterministic()
    tables.publish_forecast_month(df.withColumn("value", counted("value")), path, ["t", "tp"], "run/1", ["2019-11", "2019-12"])
    assert calls.value == 2  # each row once
    tables.publish_forecast_month(df.where("month = '2020-02'"), path, ["t"], "run/2")
    kept = {r["month"].isoformat()[:7] if hasattr(r["month"], "isoformat") else r["month"]: r for r in spark.read.parquet(f"{path}_manifest").collect()}
    assert (kept["2020-01"]["source_run_dir"], kept["2020-01"]["input_months"], kept["2020-01"]["missing_features"]) == ("run/1", ["2019-11", "2019-12"], ["tp"])
    assert (kept["2020-02"]["source_run_dir"], kept["2020-02"]["input_months"], kept["2020-02"]["rollout_steps_total"]) == ("run/2", [], 1)
    assert "_batch" not in tables.read_published(spark, path).columns


def test_cells_are_written_by_month(spark, tmp_path):
    path = str(tmp_path / "cells")
    tables.write_cells(spark.createDataFrame([("2020-01", 1, 2.0), ("2020-02", 1, None)], "month string, lat_i int, value double"), path)
    assert sorted(p.name for p in (tmp_path / "cells").glob("month=*")) == ["month=2020-01", "month=2020-02"]
    tables.write_cells(spark.createDataFrame([("2020-03", 1, 2.0)], "month string, lat_i int, value double"), path)
    assert [p.name for p in (tmp_path / "cells").glob("month=*")] == ["month=2020-03"]


@pytest.fixture
def history(spark, tmp_path):
    from gridjobs.sources import history

    shape = "run_id string, area string, forecast_month date, seq int, mae double"
    day = lambda m: datetime.date(2020, m, 1) if m else None
    make = lambda rows: spark.createDataFrame([(r, a, day(m), s, v) for r, a, m, s, v in rows], shape)
    state = lambda: sorted((r["run_id"], r["area"], r["forecast_month"] and r["forecast_month"].month, r["mae"]) for r in history.read_history(spark, str(tmp_path / "h")).collect())
    upsert = lambda rows: history.upsert_history(spark, str(tmp_path / "h"), make(rows), ["run_id", "area"])
    return history, upsert, state, tmp_path / "h", make


def test_history_rewrites_touched_months_only(spark, history):
    store, upsert, state, root, make = history
    assert store.read_history(spark, str(root)) is None
    first = [("a", "x", 1, 1, 0.1), ("a", "y", 1, 1, 0.2), ("b", "x", 2, 1, 0.3), ("c", "x", None, 1, 0.4)]
    assert upsert(first) == ["2020-01", "2020-02", "none"]
    folders = {r["month"]: r["folder"] for r in store.manifest(spark, str(root)).collect()}
    assert upsert([("b", "x", 2, 2, 0.5), ("d", "x", 3, 2, 0.6)]) == ["2020-02", "2020-03"]
    now = {r["month"]: r["folder"] for r in store.manifest(spark, str(root)).collect()}
    assert now["2020-01"] == folders["2020-01"] and now["2020-02"] != folders["2020-02"]
    assert state() == [("a", "x", 1, 0.1), ("a", "y", 1, 0.2), ("b", "x", 2, 0.5), ("c", "x", None, 0.4), ("d", "x", 3, 0.6)]
    assert upsert([("b", "x", 2, 2, 0.5), ("d", "x", 3, 2, 0.6)]) == [] == upsert(first)  # a rerun, and an older batch
    assert upsert([("b", "x", 4, 3, 0.7)]) == ["2020-04", "2020-02"]  # a key that moves leaves its old month
    assert state() == [("a", "x", 1, 0.1), ("a", "y", 1, 0.2), ("b", "x", 4, 0.7), ("c", "x", None, 0.4), ("d", "x", 3, 0.6)]
    assert store.read_history(spark, str(root), "2020-03", "2020-04").count() == 2
    wide = make([("e", "x", 3, 4, 0.9)]).withColumn("note", F.lit("n"))
    assert store.upsert_history(spark, str(root), wide, ["run_id", "area"]) == ["2020-03"]
    assert sorted(str(r["note"]) for r in store.read_history(spark, str(root)).collect()) == ["None"] * 5 + ["n"]
    assert upsert([]) == []


def test_history_survives_a_crash_before_its_manifest(spark, history, monkeypatch):
    store, upsert, state, root, _ = history
    upsert([("a", "x", 1, 1, 0.1)])
    before = state()
    with monkeypatch.context() as m:
        m.setattr(store, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            upsert([("a", "x", 1, 2, 0.9), ("b", "x", 2, 2, 0.2)])
    assert state() == before and len(list((root / "data").iterdir())) == 2
    assert upsert([("a", "x", 1, 2, 0.9), ("b", "x", 2, 2, 0.2)]) == ["2020-01", "2020-02"]
    assert state() == [("a", "x", 1, 0.9), ("b", "x", 2, 0.2)]
