"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size. A query's k-th best score in the
longest bucket is a lower bound of its final k-th; over the query's and a bucket's length it is a
local cosine threshold, by which a bucket is skipped, pruned by focus coordinates, or pruned by
length, before products are verified. From which threshold on coordinates pay is measured in every
bucket on a few of its queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.llm.common import written

#: Vectors of a bucket and of a block of queries: a vector is sent once to each block, so blocks are
#: as large as a task can hold.
BUCKET = 32_768
QUERIES = 32_768
#: Coordinates that prune, queries on which their use is measured, and what a number costs in gathered
#: rows beside one in a block of neighbouring rows.
FOCUS = 3
MEASURED = 16
GATHERED = 10.0


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where every sum stays below 2**53.

    Where a sum could pass 64 bits it is made of Python's integers, and OverflowError raised if it does.
    """
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[-1], 1)
    if largest < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) > np.iinfo(np.int64).max:
        raise OverflowError("an inner product goes beyond 64 bits")
    return exact.astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, least: float, own: int):
    """The k best (score, id) of one query, ties to smaller ids, from scores of at least `least`."""
    at = np.flatnonzero((scores >= least) & (ids != own))
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Coordinates:
    """Ranges of a bucket's unit vectors by their coordinates."""

    def __init__(self, c: np.ndarray, c_len: np.ndarray):
        self.unit = c / np.maximum(c_len, 1e-300)[:, None]
        self.ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def focus(self, u: np.ndarray, t: float) -> list[tuple[int, int, int, float, float]]:
        """(size, coordinate, start, low, high) of the query's largest coordinates, the smallest range first."""
        out = []
        for f in np.argsort(-np.abs(u))[:FOCUS].tolist():
            if f not in self.ranked:
                by = np.argsort(self.unit[:, f], kind="stable")
                self.ranked[f] = by, self.unit[by, f]
            # the angle to the axis differs from the query's by at most the angle of the threshold
            own, most = np.arccos(np.clip(u[f], -1, 1)), np.arccos(t)
            low, high = np.cos(min(own + most, np.pi)) - 1e-9, np.cos(max(own - most, 0.0)) + 1e-9
            a, b = np.searchsorted(self.ranked[f][1], low, side="left"), np.searchsorted(self.ranked[f][1], high, side="right")
            out.append((int(b - a), f, int(a), low, high))
        return sorted(out)

    def kept(self, u: np.ndarray, t: float) -> np.ndarray:
        """Vectors of the bucket whose focus coordinates allow the threshold."""
        told = self.focus(u, t)
        n, f, a, _, _ = told[0]
        at = self.ranked[f][0][a : a + n]
        for _, f, _, low, high in told[1:]:
            at = at[(self.unit[at, f] >= low) & (self.unit[at, f] <= high)]
        return at


def switch_point(q: np.ndarray, q_len: np.ndarray, local: np.ndarray, by_length: np.ndarray, coordinates: Coordinates) -> float:
    """The local threshold from which on coordinates are used: the one that costs some of the queries least.

    by_length: how many vectors length leaves each query. Infinite if length alone is cheapest.
    """
    asked = np.flatnonzero((local > 0) & (local <= 1 + 1e-9))
    asked = asked[np.argsort(local[asked], kind="stable")]
    asked = asked[np.unique(np.linspace(0, len(asked) - 1, MEASURED).astype(int))] if len(asked) else asked
    saved, best, most = 0.0, float("inf"), 0.0
    for i in asked[::-1]:
        u, t = q[i] / q_len[i], min(local[i], 1.0)
        looked_at, multiplied = coordinates.focus(u, t)[0][0], len(coordinates.kept(u, t))
        saved += by_length[i] * q.shape[1] - GATHERED * (looked_at * (FOCUS - 1) + multiplied * q.shape[1])
        if saved > most:
            best, most = float(local[i]), saved
    return best


def search_bucket(q_ids, q, least, c_ids, c, k: int = 5, measured: dict | None = None):
    """(query id, vector id, score) of each query's best k in a bucket that reach its bound.

    measured, if given, takes the switch point and how many queries went which way.
    """
    c_len, q_len = np.sqrt((c.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c_ids, c, c_len = c_ids[order], c[order], c_len[order]
    reach = q_len * c_len[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, least / reach, np.where(least > 0, 2.0, -1.0))
        short = np.where((q_len > 0) & np.isfinite(least), least / np.maximum(q_len, 1e-300), -1.0) * (1 - 1e-9)
    by_length = np.where(short > 0, np.searchsorted(-c_len, -short, side="right"), len(c))
    coordinates = Coordinates(c, c_len)
    switch = switch_point(q, q_len, local, by_length, coordinates)
    out = []
    some = np.flatnonzero((local < switch) & (local <= 1 + 1e-9))
    some = some[np.argsort(by_length[some], kind="stable")]  # queries with like prefixes together
    step = max(1, (1 << 22) // max(len(c), 1))
    for at in range(0, len(some), step):
        few = some[at : at + step]
        m = int(by_length[few].max())
        scores = products(q[few], c[:m])
        for row, i in zip(scores, few):
            out += [(q_ids[i], c_ids[j], row[j]) for j in best_of(row, c_ids[:m], k, least[i], q_ids[i])]
    chosen = np.flatnonzero((local >= switch) & (local <= 1 + 1e-9))
    for i in chosen:
        at = coordinates.kept(q[i] / q_len[i], min(local[i], 1.0))
        if len(at):
            row = products(q[i : i + 1], c[at])[0]
            out += [(q_ids[i], c_ids[at[j]], row[j]) for j in best_of(row, c_ids[at], k, least[i], q_ids[i])]
    if measured is not None:
        measured.update(switch=switch, by_length=len(some), by_coordinates=len(chosen))
    return out


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bucket: int = BUCKET, block: int = QUERIES) -> DataFrame:
    """The k vectors of highest integer product for every query, ties to smaller vec_id, with rank.

    vectors, queries: vec_id, v (array<long>); other columns are not read. Only vectors of a query's
    dimension are compared; rows with a query's own vec_id are left out; repeated rows count each; a
    query id of several rows asks with each and ranks what they find together; a query with fewer
    vectors gets all; none gives no rows. Length classes (fixed ratio of squared lengths) are split by
    a hash of vector and place into buckets of about `bucket` rows, so copies of one vector spread, and
    queries into blocks of about `block`. A task holds one of each; pairs of bucket and block that the
    bounds rule out are not formed.
    """
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squared).alias("len"))
    base = base.withColumn("class", F.when(F.col("len") > 0, F.floor(F.log2("len") * 8)).otherwise(-1 << 20).cast("int"))
    base = written(base.withColumn("place", F.monotonically_increasing_id()), "topk-rows")
    sizes = base.groupBy("dim", "class").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("vec_id", "place"), F.ceil(F.col("n") / bucket)).cast("int")
    # classes of lengths are few: eight to a doubling
    base = written(base.join(sizes, ["dim", "class"]).withColumn("part", part).drop("n", "place"), "topk-vectors")
    asked = written(queries.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(squared).alias("len"), F.monotonically_increasing_id().alias("place")), "topk-asked")
    blocks = asked.groupBy("dim").agg(F.count("*").alias("n"))
    asked = asked.join(blocks, "dim").select("vec_id", "v", "dim", "len", F.pmod(F.xxhash64("vec_id", "place"), F.ceil(F.col("n") / block)).cast("int").alias("block"))
    asked = written(asked, "topk-queries")
    buckets = base.groupBy("dim", "class", "part").agg(F.max("len").alias("longest"), F.count("*").alias("n"))
    key = ["dim", "class", "part", "block"]

    def run(_, q, c):
        import pandas as pd

        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(q["dim"].iloc[0])
        matrix = lambda x: np.array(x["v"].tolist(), np.int64).reshape(len(x), dim)
        ids, rows = c["vec_id"].to_numpy(np.int64), matrix(c)
        found = search_bucket(q["vec_id"].to_numpy(np.int64), matrix(q), q["least"].to_numpy(float), ids, rows, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(asked, pairs):
        keys = [F.col(x).alias(x) for x in key]  # columns of each side's own, though both come from pairs
        left = asked.join(pairs, ["dim", "block"]).select(*keys, "vec_id", "v", "least")
        right = base.join(pairs, ["dim", "class", "part"]).select(*keys, "vec_id", "v")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, FOUND)

    own = asked.select("dim", "block").distinct()
    seed = buckets.filter(F.col("n") > k).groupBy("dim").agg(F.max_by(F.struct("class", "part"), F.struct("longest", "n", "class", "part")).alias("s")).select("dim", "s.class", "s.part")
    first = searched(asked.withColumn("least", F.lit(float("-inf"))), own.join(seed, "dim"))
    bound = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    bounded = asked.join(bound, asked["vec_id"] == bound["query_id"], "left").withColumn("least", F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(float("-inf"))).drop("query_id", "s", "n")
    bounded = written(bounded, "topk-bounds")
    # the least length any query of a block needs
    reach = bounded.groupBy("dim", "block").agg(F.min(F.when((F.col("least") > 0) & (F.col("len") > 0), F.col("least") / F.col("len")).when(F.col("least") > 0, F.lit(float("inf"))).otherwise(-1.0)).alias("needs"))
    pairs = reach.join(buckets, "dim").filter(F.col("longest") >= F.col("needs") * (1 - 1e-9)).select(*key)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return searched(bounded, pairs).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of vectors whose components are all finite numbers.

    A vector that is null or holds a null, a nan or an infinity takes no part, nor does a null vec_id. A
    finite component that is no 64-bit integer then is an error, as its score would be none either.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e * float(scale)) < float(1 << 63), F.floor(e * float(scale))).otherwise(F.raise_error("an embedding component is beyond 64 bits").cast("long"))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
