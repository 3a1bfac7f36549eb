"""Mixing sources to target weights by systematic sampling.

Within a source each document has the same expected number of copies, target words over own
words. Expected copies are summed along the documents in order of size, one random offset per
source is added, and a document is emitted once for each integer the sum crosses at it. In order
of size, the words taken differ from the target by less than the source's largest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.common import cut, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def hashed(*cols) -> F.Column:
    """A fixed random number in [0, 1) from md5, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources (source, source_size, first): weights repeat along the order of first.

    A target stops at most times the source's words; what is over goes to the others by weight,
    round by round, until none is above. A round is one aggregate of the small source table.
    """
    ranked = numbered(sources, F.col("first"), name="rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = cut(ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("limit")
        r = ranked.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)).alias("kept"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if not r["open"] or r["n"] == full:
            break
        level, full = (share * total - r["kept"]) / r["open"], r["n"]
    return ranked.withColumn("target", F.least("limit", F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST, more: tuple[str, ...] = ()) -> DataFrame:
    """Add size, source_size, target and copies to every row's (doc_id, source) and more columns.

    Order within a source: words, then a hash of doc_id, then doc_id. Rows are range-partitioned by
    it, so a hot source spreads over tasks; a prefix sum is a position times a constant. Null text has
    no words; a null source is a source of its own, the last; sources without words have target 0;
    repeated rows count each; an empty table gives none. Other columns, whatever their names, are not
    read; after the first pass no task holds a text.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *more)
    slim = slim.withColumn("h", hashed(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = written(slim, "mix-sizes")  # so that words are counted once, not once more for the range bounds
    order = F.col("source").asc_nulls_last(), F.col("size"), F.col("h"), F.col("doc_id").asc_nulls_first()
    at = written(numbered(slim, *order), "mix-order")
    sources = at.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("idx").alias("first"))
    targets = written(source_targets(sources, weights, share, most).select(F.col("source").alias("s"), "source_size", "target", "first"), "mix-targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = hashed(F.lit(seed), F.lit("start"), F.coalesce("source", F.lit("")))
    joined = at.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("each", each).withColumn("start", start)
    place = F.col("idx") - F.col("first")
    crossed = lambda k: F.floor(F.col("each") * k + F.col("start"))
    return joined.withColumn("copies", crossed(place + 1) - crossed(place)).select("doc_id", "source", "size", "source_size", "target", "copies", *more)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS h,
    CAST(('0x' || substr(md5('mix|start|' || coalesce(source, '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS start
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS w
  FROM docs GROUP BY source),
rounds AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * sum(source_size)::DOUBLE - sum(CASE WHEN w * level >= 2.0 * source_size THEN 2.0 * source_size ELSE 0 END)::DOUBLE)
      / nullif(sum(CASE WHEN w * level >= 2.0 * source_size THEN 0 ELSE w END)::DOUBLE, 0) FROM sources)
  FROM rounds WHERE k < 60 AND level IS NOT NULL),
final AS (SELECT max(level) AS level FROM rounds),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(2.0 * source_size::DOUBLE, w * level)::DOUBLE AS target FROM sources, final),
placed AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) - 1 AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END::DOUBLE AS each
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, CAST(floor(each * (place + 1) + start) - floor(each * place + start) AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM taken
"""
