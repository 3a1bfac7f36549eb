"""What several operators share: lineage cuts in shared storage and gapless ordering."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a plain local master (tests) may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a durable lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of an Arrow batch of texts, where the session has Spark's own number.
BATCH, SPARKS_BATCH = 2000, "10000"


def text_batches(spark: SparkSession) -> None:
    """Let Python workers get fewer rows at once than Spark would send, as rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARKS_BATCH:
        spark.conf.set(name, str(BATCH))


def given_back() -> None:
    """Return freed memory to the system at a task's end, as its Python worker lives on for later stages."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps the partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order, name: str = "idx", parts: int | None = None) -> DataFrame:
    """Add a gapless 0-based number in the given order without a single-task window.

    Rows are range-partitioned and sorted, the layout is fixed by a checkpoint, and each
    partition's offset (one row per partition) is added to its local row numbers. Include a
    tie-breaker in order, so equal keys can spread over partitions.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    at = laid.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    counts = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [0] * (max(counts, default=0) + 1), 0
    for p in range(len(starts)):
        starts[p], total = total, total + counts.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("_p") + 1)
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn(name, offset + local).drop("_p", "_m")


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (0 for null), no_id, text and more columns: pandas would turn ids beside a null into floats."""
    text_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("string").alias("text"), *more)


def id_list(batch, a: int = 0, b: int | None = None) -> list[int | None]:
    """Exact ids of rows a to b of a batch of ids_and_texts."""
    return [None if none else int(i) for i, none in zip(batch["doc_id"].to_numpy()[a:b], batch["no_id"].to_numpy()[a:b])]


def frame(rows: list[tuple], schema: str, ids: str = "doc_id"):
    """Rows as pandas with the schema's names and exact, nullable ids."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    at = names.index(ids)
    out = pd.DataFrame([r[:at] + (0,) + r[at + 1 :] for r in rows], columns=names)
    out[ids] = pd.array([r[at] for r in rows], dtype="Int64")
    return out
