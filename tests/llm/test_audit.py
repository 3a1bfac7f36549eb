"""The filter audit against SQL and against a plain walk through every order."""

import itertools
import re

import duckdb
from pyspark.sql import functions as F

from gridjobs.llm import audit
from tests.compare import same
from tests.llm.test_operators import DOCS, HARD

DATA = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Wanted rows from (doc_id, text, source) and (doc_id, quality, toxic), each document walked through."""
    failed = []
    for k, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        bad += "E" * (k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in docs))
        mine = [x for x in labels if x[0] == k and k is not None]
        failed.append((source or "", bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {x[0] for x in failed}:
        own, rows, total = [x for x in failed if x[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                total[f] += len(gone)
                rows.append((part, "".join(order), step + 1, len(kept), len(gone), redundant, sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
                left = kept
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = audit.op12_filter_audit(spark, DATA).toPandas()
    assert len(got) == 600 * got["part"].nunique()
    same(got, con.execute(audit.OP12_SQL).df())


def test_audit_hard_cases(spark):
    """Nulls, empties, repeated rows and ids, repeated and conflicting labels, a long text, odd columns."""
    long = " ".join(f"w{i}" for i in range(250))
    rows = [*HARD, (9, long, "en", "a", 1), (10, long, "en", "", 1), (8, long, "en", "a", 1), (11, long + " #", "en", "c", 1), (12, "Aa Bb " * 150, "en", None, 1), (13, None, "en", "a", 0), (None, long, "en", "a", 1), (14, "x y " * 100_000, "en", "c", 1)]
    labels = [(1, 1, 0), (9, 1, 1), (9, 1, 1), (10, 0, 1), (10, 1, 0), (None, 1, 1), (11, None, 1), (14, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("words", "mask", "digest", "part", "good", "toxic", "id", "least", "n", "steps", "cells", "filter")})
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = sorted(tuple(r) for r in audit.audit(docs, told).collect())
    assert got == brute([(r[0], r[1], r[3]) for r in rows], labels)
    assert audit.audit(spark.createDataFrame([], DOCS), told).count() == 0
    assert audit.audit(docs, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_shares_of_all_orders_add_up(spark):
    """What all filters remove over all orders is 120 times what any one order removes."""
    rows = audit.op12_filter_audit(spark, DATA)
    by_part = rows.groupBy("part").agg(F.sum("removed").alias("r"))
    one = rows.filter("filter_order = 'CABED'").groupBy("part").agg(F.sum("removed").alias("one"), F.sum("shapley").alias("s"))
    for r in one.join(by_part, "part").collect():
        assert r["r"] == 120 * r["one"] == r["s"]


def test_plan_has_no_python(spark):
    plan = audit.op12_filter_audit(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
