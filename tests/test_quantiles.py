"""Quantiles by selection against numpy, over hard distributions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.operators import quality, quantiles, verify
from gridjobs.plans import catalog

DATA = "/root/testdata/sf0.001"
SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def distributions():
    rng = random.Random(0)
    return {
        "even": [rng.random() for _ in range(700)],
        "one": [3.5],
        "ties": [1.0] * 400 + [2.0] * 399 + [float(rng.randrange(4)) for _ in range(90)],
        "magnitudes": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "tiny": [rng.random() * 1e-310 for _ in range(200)] + [0.0, -0.0],
        "huge": [rng.choice([-1, 1]) * 1.7e308 * rng.random() for _ in range(300)],
        "outlier": [rng.random() for _ in range(500)] + [1e18],
        "infinite": [-math.inf] * 30 + [rng.random() for _ in range(50)] + [math.inf] * 20,
    }


@pytest.mark.parametrize("kept, most", [(1 << 12, 1 << 12), (8, 16), (1, 64)])
def test_selection(spark, monkeypatch, kept, most):
    """In one pass, and with so few buckets and rows sorted that many passes are needed."""
    monkeypatch.setattr(quantiles, "SORTED", kept)
    monkeypatch.setattr(quantiles, "MOST", most)
    data = distributions()
    rows = [(g, float(v), -float(v)) for g, vs in data.items() for v in vs] + [(None, 1.0, None), (None, 2.0, None), ("nulls", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(3)
    got = {(r["g"], r["column_name"]): r["q"] for r in quantiles.column_quantiles(df, ["a", "b"], SHARES, ("g",)).collect()}
    assert set(got) == {(g, c) for g in data for c in "ab"} | {(None, "a")}
    for g, vs in [*data.items(), (None, [1.0, 2.0])]:
        for c, sign in (("a", 1), ("b", -1)):
            if g is not None or c == "a":
                with np.errstate(all="ignore"):
                    want = np.quantile(sign * np.array(vs), SHARES) if g not in ("infinite", "huge") else None
                ordered = sorted(sign * v for v in vs)
                for k, s in enumerate(SHARES):
                    place = s * (len(vs) - 1)
                    low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
                    assert low <= got[g, c][k] <= high
                    if want is not None:
                        assert math.isclose(got[g, c][k], want[k], rel_tol=1e-12, abs_tol=1e-300), (g, c, s)


def test_not_a_number_comes_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "a double")
    q = quantiles.column_quantiles(df, ["a"], (0.0, 0.5, 1.0)).first()["q"]
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])


def test_buckets_never_fall(spark):
    vs = sorted(v for vs in distributions().values() for v in vs if math.isfinite(v))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double")
    for low, high in ((vs[0], vs[-1]), (0.0, 1.0), (0.0, 1e18), (-1e-312, 3.0)):
        told = df.where(F.col("v").between(low, high)).select("i", quantiles.bucket_of(F.col("v"), F.lit(low), F.lit(high), 50).alias("b")).orderBy("i").collect()
        bs = [r["b"] for r in told]
        assert bs == sorted(bs) and 0 <= bs[0] < bs[-1] <= 49
    ends = spark.createDataFrame([(5e-324, 1e-323), (-1.7e308, 1.7e308), (1.0, 1.0 + 2**-52), (-5e-324, 0.0)], "a double, b double")
    for r in ends.select(quantiles.bucket_of(F.col("a"), F.col("a"), F.col("b"), 16).alias("a"), quantiles.bucket_of(F.col("b"), F.col("a"), F.col("b"), 16).alias("b")).collect():
        assert (r["a"], r["b"]) == (0, 15)


@pytest.mark.parametrize("seed", range(4))
def test_median_exceeds(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([None, 149.0, 150.0, 150.5, 151.0, rng.uniform(100, 200)])) for g in range(60) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in df.groupBy("g").agg(quantiles.median_exceeds("v", 150).alias("over")).collect():
        vs = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["over"] == (bool(np.median(vs) > 150) if vs else None)


def test_profile_of_an_empty_table(spark):
    rows = quality.profile(spark.createDataFrame([], "a double, b string, c int"), ["a", "b", "c"]).collect()
    assert sorted(r["column_name"] for r in rows) == ["a", "b", "c"]
    for r in rows:
        assert r["missing"] == r["count"] == 0 and all(r[c] is None for c in ("missing_pct", "mean", "std", "min", "q25", "q50", "q75", "max"))
    nulls = quality.profile(spark.createDataFrame([(None, "x"), (None, None)], "a double, b string"), ["a", "b"])
    assert {r["column_name"]: (r["missing_pct"], r["q50"]) for r in nulls.collect()} == {"a": (100.0, None), "b": (50.0, None)}
    text = quality.profile(spark.createDataFrame([("x",)], "b string"), ["b"])
    assert text.first()["q25"] is None


def test_no_buffer_of_all_values_in_the_plans(spark):
    f = catalog.Fixtures(spark, DATA)
    for df in (quality.profile(f.grid_obs.select("t2m"), ["t2m"]), catalog.queries()["kelvin_guard"](spark, DATA), verify.dashboard(catalog.graded(f))):
        assert "percentile" not in df._jdf.queryExecution().executedPlan().toString().lower()
