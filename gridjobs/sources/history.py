"""A history kept as a stored table: batches rewrite the months that they touch, a manifest says what counts.

    root/data/<version>/_month=YYYY-MM/   rows of one month as of one version
    root/manifest/<version>/              for every month its folder, rows and digest, in one file

A version counts once its manifest is there, which is written last and in one file. So a job that dies
between data and manifest leaves the history as it was, and what it wrote is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.operators.verify import history_upsert

MANIFEST = "version int, month string, folder string, rows long, digest string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(version, month, folder, rows, digest) of every month as of the last version; none without one."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    last = rows.agg(F.max("version").alias("_last"))
    return rows.join(F.broadcast(last), F.col("version") == F.col("_last")).drop("_last")


def write_manifest(spark: SparkSession, root: str, version: int, months: list[tuple]) -> None:
    told = spark.createDataFrame([(version, *m) for m in months], MANIFEST)
    told.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/{version:08d}")


def months_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Rows of month folders, with the columns that any of them has."""
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def read_history(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """The history as of its last version, None if there is none; of months yyyy-MM from start to end, if
    given: other months' files are not listed."""
    months = manifest(spark, root)
    if start:
        months = months.where(F.col("month").between(start, end))
    folders = [r["folder"] for r in months.select("folder").collect()]  # one for each month
    return months_of(spark, folders) if folders else None


def _label(month: str) -> Column:
    return F.coalesce(F.date_format(month, "yyyy-MM"), F.lit("none"))


def upsert_history(spark: SparkSession, root: str, new: DataFrame, keys: list[str], month: str = "forecast_month") -> list[str]:
    """Add a batch and keep the last row of each key, as history_upsert; the months that changed.

    Read are the months of the batch, and the keys of the others, as a key may have had another month;
    rewritten are the months whose rows differ afterwards, so a batch that is stored already changes
    nothing. Rows without a month have a folder of their own. One job at a time writes a history.
    """
    known = {r["month"]: r for r in manifest(spark, root).collect()}  # one row for each month
    version = max((r["version"] for r in known.values()), default=0) + 1
    touched = {r["m"] for r in new.select(_label(month).alias("m")).distinct().collect()}
    others = [r["folder"] for m, r in known.items() if m not in touched]
    if others:
        moved = months_of(spark, others).join(new.select(*keys).distinct(), keys, "left_semi")
        touched |= {r["m"] for r in moved.select(_label(month).alias("m")).distinct().collect()}
    if not touched:
        return []
    old = [known[m]["folder"] for m in touched if m in known]
    merged = history_upsert(months_of(spark, old), new, keys) if old else history_upsert(new, new.limit(0), keys)
    data = f"{root}/data/{version:08d}-{uuid.uuid4().hex}"
    merged.withColumn("_month", _label(month)).write.partitionBy("_month").parquet(data)
    written = spark.read.option("basePath", data).parquet(data)
    columns = sorted(c for c in written.columns if c != "_month")
    digest = F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")
    now = {r["m"]: (r["n"], r["d"]) for r in written.groupBy(F.col("_month").cast("string").alias("m")).agg(F.count("*").alias("n"), digest.alias("d")).collect()}
    shape = ",".join(columns)
    stored = {m: (r["rows"], r["digest"]) for m, r in known.items()}
    changed = sorted(m for m, (n, d) in now.items() if (n, f"{d}:{shape}") != stored.get(m))
    gone = sorted(m for m in touched if m in known and m not in now)
    if not changed and not gone:
        return []
    kept = [(m, r["folder"], r["rows"], r["digest"]) for m, r in known.items() if m not in changed and m not in gone]
    write_manifest(spark, root, version, kept + [(m, f"{data}/_month={m}", now[m][0], f"{now[m][1]}:{shape}") for m in changed])
    return changed + gone
