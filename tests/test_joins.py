"""Joins that move little: orbits, sorted neighbours, stored pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridjobs.functions import grid
from gridjobs.operators import metrics, verify
from tests.compare import rows

PAIRS = "run_id string, grp string, variable string, lat_index int, lon_index int, predicted double, observed double"


def maps(spark, height, width, seed=0, twice=True):
    rng = random.Random(seed)
    data = [(r, g, v, i, j, rng.choice([None, rng.random()]), rng.random()) for r, g, v in (("a", "climate", "t2m"), ("b", "climate", "tp")) for i in range(height) for j in range(width) if rng.random() > 0.15]
    return spark.createDataFrame(data + data[: 3 * twice], PAIRS)


@pytest.mark.parametrize("height, width", [(4, 6), (5, 5), (1, 4), (3, 2)])
def test_orbits_give_the_pairs_of_the_join(spark, height, width):
    pairs = maps(spark, height, width)
    keys = ["run_id", "grp", "variable"]
    want = None
    for name, turn in metrics.SCENARIOS.items():
        turned = grid.flip(pairs.drop("observed"), *turn, height, width).join(pairs.drop("predicted"), [*keys, "lat_index", "lon_index"])
        own = metrics.continuous_metrics(turned, keys).withColumn("scenario", F.lit(name))
        want = own if want is None else want.unionByName(own)
    names = [f.name for f in want.schema.fields if f.dataType.typeName() == "double"]
    cut = lambda df: rows(df.withColumns({c: F.round(c, 6) + 0.0 for c in names}).toPandas())
    assert cut(metrics.alignment_scenarios(pairs, ["run_id"], height, width)) == cut(want)


def test_orbits_have_one_scan_and_no_join(spark, tmp_path):
    maps(spark, 4, 6).write.parquet(str(tmp_path / "p"))
    plan = metrics.alignment_scenarios(spark.read.parquet(str(tmp_path / "p")), ["run_id"], 4, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 2


@pytest.mark.parametrize("seed", range(4))
def test_nearest_of_sorted_neighbours(spark, seed):
    rng = random.Random(seed)
    source = [rng.choice([rng.uniform(0, 10), rng.randrange(40) / 4, 5.0]) for _ in range(rng.choice([1, 3, 60]))] + [None]
    target = [rng.choice([rng.uniform(-3, 13), rng.randrange(80) / 8, -50.0, 50.0]) for _ in range(90)] + [None]
    a, b = (spark.createDataFrame([(x,) for x in xs], "x double") for xs in (source, target))
    got = {r["target"]: r["source"] for r in grid.nearest_to_grid(a, b, "x", ranges=rng.choice([1, 2, 7, 64])).collect()}
    known = [s for s in source if s is not None]
    assert got == {t: min(known, key=lambda s: (abs(s - t), -s)) for t in target if t is not None}
    plan = grid.nearest_to_grid(a, b, "x")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_empty_axes(spark):
    some, none = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([], "x double")
    assert grid.nearest_to_grid(none, some, "x").count() == grid.nearest_to_grid(some, none, "x").count() == 0


def test_stored_pairs_are_joined_without_an_exchange(spark, tmp_path):
    pairs = maps(spark, 4, 6, twice=False)
    runs = spark.createDataFrame([("a", True, None), ("c", True, True)], "run_id string, latitude_flip boolean, longitude_flip boolean")
    names, keys = ("stored_predicted", "stored_observed"), ["variable"]
    try:
        verify.store_pairing(spark, pairs, pairs, runs, names, keys, 5, (str(tmp_path / "p"), str(tmp_path / "o")), size=(4, 6))
        for kept in (False, True):
            got = verify.pair_stored(spark, names, keys, kept)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
            want = verify.pair_runs(pairs, pairs, runs, keys, size=(4, 6), keep_unmatched=kept)
            assert rows(got.toPandas()) == rows(want.toPandas()) and got.count() > 20
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_history_ties_do_not_depend_on_row_order(spark):
    data = [("k", 1, "x", 2.0), ("k", 1, "y", 1.0), ("k", 1, "y", None), ("j", None, "a", 1.0), ("j", 0, "a", 0.5)]
    shape = "key string, seq int, note string, value double"
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, shape)
        got = verify.history_upsert(df, df.limit(0), ["key"]).collect()
        assert sorted((r["key"], r["seq"], r["note"], r["value"]) for r in got) == [("j", 0, "a", 0.5), ("k", 1, "y", 1.0)]
