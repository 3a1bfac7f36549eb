"""Every registered grid query against its SQL on the smallest tables."""

import duckdb
import pytest

from gridjobs.plans import catalog
from gridjobs.plans.fixtures import Fixtures
from tests.compare import same

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    out = catalog.queries()[name](spark, DATA)
    if sql := catalog.oracle_sql().get(name):
        same(out.toPandas(), db.execute(sql).df())
    else:
        assert out.count() > 0


def test_plans_stay_in_the_engine(spark):
    """No Python but for names, and no cartesian product but of small dimensions."""
    for name in ("continuous_metrics", "area_month", "carry_forward", "regrid_pixels", "areas_range_join", "kpis"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_flattened_manifest_has_every_run(spark):
    runs = Fixtures(spark, DATA).runs
    values = catalog.queries()["flatten_manifest"](spark, DATA).where("key = 'paths'")
    assert sorted(r["value"] for r in values.collect()) == sorted(f'["{r["path"]}"]' for r in runs.collect())
