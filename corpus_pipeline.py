"""A corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and
rereads it for the next. All but the last return the columns of documents. Null and empty texts,
repeated rows, extra columns and empty tables pass through each stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm.common import dropped, written
from gridjobs.llm.jaccard import FEW, keyed_duplicates
from gridjobs.llm.mixing import mix_sources
from gridjobs.llm.packing import pack_documents
from gridjobs.llm.quality import fit, score_documents
from gridjobs.llm.secrets import redact
from gridjobs.llm.tokens import path_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def join_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with (or without) a doc_id and key of keys, null-safe; keys are broadcast only if counted few."""
    told = keys.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    told = F.broadcast(told) if keys.count() <= FEW else told
    return docs.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from the labels of this stage's documents; without any, all are kept. Null and empty
    texts score by the bias; repeated rows are scored alike.
    """
    weights = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return documents(score_documents(documents(docs), weights).filter("predicted = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least doc_id (null comes last) and,
    among the rows of that doc_id, the least hash of its text.

    Documents without words are groups of their own. Rows of one doc_id, null being one too, are
    different documents if their texts differ; with equal texts they are one, of which one row stays.
    """
    docs = documents(docs).withColumn("key", F.xxhash64("text"))
    found = keyed_duplicates(docs.select("doc_id", "key", "text"))
    least = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = written(found.groupBy("doc_id", "key", "component").agg(least.alias("least"), F.count("*").alias("n")), "pipeline-rows")
    first = rows.filter("least and component is not null")
    tied = first.groupBy("component").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
    later = written(first.join(tied, "component").filter("key <> lo").select("doc_id", "key"), "pipeline-ties")
    some = join_keys(docs, rows.filter("not least").select("doc_id", "key").union(later), "left_anti")
    repeated = rows.filter("least and n > 1")
    if repeated.isEmpty():
        return documents(some)
    again = join_keys(some, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("source", "lang", "n_chars")).alias("row")).select("doc_id", "text", "row.*")
    return documents(join_keys(some, repeated, "left_anti")).unionByName(documents(again))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and n_chars counted anew; null texts stay null."""
    return documents(redact(documents(docs)).withColumn("n_chars", F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix of sources takes it.

    Rows are told apart by a number stored beside them, so null and repeated ids, and equal rows, meet
    in no one task. Documents of no words have copies like others of their source.
    """
    rows = written(documents(docs).withColumn("_at", F.monotonically_increasing_id()), "pipeline-numbered")
    taken = mix_sources(rows.select("doc_id", "text", "source", "_at"), more=("_at",)).filter("copies > 0").select("_at", "copies")
    return documents(rows.join(taken, "_at").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs, path_of("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A trained classifier and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
