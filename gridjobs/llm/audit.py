"""Interaction of document filters over all their orders, by folds of higher-order SQL functions.

Each document is a mask of the filters that it fails. Documents of a part with the same mask are one cell,
at most 32 to a part. Each cell folds across the array of all orders: transform over the orders, aggregate
over an order's steps, so a cell gives a struct of counts for every order and step (600 of them). The
structs of a part's cells are merged by elementwise sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, characters of the third and the fourth filter.
WORD, CAPITALS, MARKS = r"[^\x20\x09-\x0D]+", "[A-Z]+", "[#$%&*|]"
LETTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask): bit k of mask is set if the document fails the k-th filter of ABCDE.

    part: the source, null as ''. Null text counts as empty. A copy is a row whose text some row of a
    smaller doc_id has; equal ids are no copies of each other, a null id neither is one nor makes one.
    Texts are read once; from then on a row is a few numbers and a digest, and only digests that occur
    twice come to the join that tells copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    capitals = F.length("text") - F.length(F.regexp_replace("text", CAPITALS, ""))
    bit = lambda k, fails: F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
    own = bit(0, n < limits.words) + bit(1, 100 * distinct < limits.distinct_percent * n) + bit(2, 100 * capitals.cast("long") > limits.capital_percent * F.length("text").cast("long")) + bit(3, F.col("text").rlike(MARKS))
    slim = slim.select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    repeated = slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return slim.join(repeated, "digest", "left").select("doc_id", "part", (F.col("mask") + bit(4, copy)).alias("mask"))


def orders(filters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def cell_steps(mask: Column, n: Column, good: Column, toxic: Column, filters: str = LETTERS) -> Column:
    """array<struct<...COUNTS>>, order by order and step by step: what n documents of one mask count."""
    bits = F.array(*(F.array(*(F.lit(1 << filters.index(f)) for f in o)) for o in orders(filters)))
    none = F.lit(0).cast("long")
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>").alias("steps"))

    def step(acc, bit):
        fails, gone = mask.bitwiseAND(bit) != 0, acc["gone"]
        here = fails & ~gone
        only = lambda when, c: F.when(when, c).otherwise(none)
        counts = (only(~fails & ~gone, n), only(here, n), only(fails & gone, n), only(mask == bit, n), only(here, good), only(here, toxic))
        return F.struct((gone | fails).alias("gone"), F.array_append(acc["steps"], F.struct(*(x.alias(c) for x, c in zip(counts, COUNTS)))).alias("steps"))

    return F.flatten(F.transform(bits, lambda order: F.aggregate(order, start, step, lambda acc: acc["steps"])))


def interactions(masks: DataFrame, filters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    (part, mask, good, toxic) of every document.

    A part's rows come from at most 32 cells, which are counted before they are shuffled, so the share of
    a part doesn't matter; a part without documents has no rows. Null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(flag("good")).alias("good"), F.count_if(flag("toxic")).alias("toxic"))
    cells = cells.select("part", cell_steps(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), filters).alias("steps"))
    summed = lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTS))
    first, rest = F.element_at("cells", 1), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    merged = cells.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.aggregate(rest, first, lambda a, b: F.zip_with(a, b, summed)).alias("steps"))
    names = F.array(*(F.lit(o) for o in orders(filters)))
    rows = merged.select("part", F.posexplode("steps").alias("at", "s")).select("part", F.element_at(names, F.floor(F.col("at") / len(filters)).cast("int") + 1).alias("filter_order"), (F.col("at") % len(filters) + 1).cast("int").alias("step"), "s.*")
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    total = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of `interactions` for docs (doc_id, text, source) with labels (doc_id, quality, toxic).

    A label counts if any row of its doc_id has it, so repeated labels count a document once; documents
    without labels, or without doc_id, are neither good nor toxic. Repeated rows of docs count each; an
    empty table gives no rows. Other columns are not read. A task holds one text and its words at a time.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id is not null")
    told = told.groupBy("id").agg(F.max(F.col("quality").cast("long") == 1).alias("good"), F.max(F.col("toxic").cast("long") == 1).alias("toxic"))
    masks = failures(docs, limits)
    return interactions(masks.join(told, F.col("doc_id") == F.col("id"), "left").select("part", "mask", "good", "toxic"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(docs.doc_id > least, false) AS e
  FROM docs JOIN first USING (t) LEFT JOIN told ON docs.doc_id = told.doc_id),
cells AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE p.x NOT IN (q.x, r.x, s.x, u.x) AND q.x NOT IN (r.x, s.x, u.x) AND r.x NOT IN (s.x, u.x) AND s.x <> u.x),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS f, filter_order[1:k - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
each AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS bad, fails = f AS alone,
    before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
