"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.chunks import Growing
from gridjobs.llm.common import given_back, text_batches

BITS = 18
#: Most labelled rows that a fit reads, and the models it averages.
SAMPLE = 30_000
SHARDS = 8
#: Passes of a model over its examples, however many it has.
PASSES = 40
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.001, 0.001

_words = re.compile(r"\w+|[^\w\s]+").findall


class Hashed(dict):
    """Hashes of words met by this worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = Hashed()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text's words and pairs of neighbouring words, lower-cased.

    Values are logarithms of counts, of unit length together; slot 0 with value 1 is the bias, slot 1 a word said twice.
    """
    found = _words(text.lower()) if isinstance(text, str) else []
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    pairs[h[:-1] == h[1:]] = 1  # a word followed by itself, whichever it is
    ones = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    slots, counts = np.unique(np.concatenate([np.maximum(ones, 2), np.maximum(pairs, 1)]), return_counts=True)
    x = np.log1p(counts)
    x /= max(np.sqrt(x @ x), 1e-9)
    return np.append(slots.astype(np.int64), 0), np.append(x, 1.0)


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def score(text: str | None, weights: np.ndarray) -> float:
    """Sparse dot product of weights and features, as a probability."""
    slots, x = features(text, len(weights).bit_length() - 1)
    return probability(weights[slots] @ x)


class Leader:
    """Per-coordinate follow-the-regularised-leader state."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights_at(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights_at(slots)
        g = (probability(w @ x) - label) * x
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(texts, labels, bits: int = BITS) -> np.ndarray:
    """Weights of one leader that goes through the examples PASSES times, in their order."""
    slots, values = Growing(np.int32), Growing(np.float32)
    for text in texts:
        at, x = features(text, bits)
        slots.extend([at])
        values.extend([x])
    leader, ends = Leader(bits), slots.ends.tolist()
    for _ in range(PASSES):
        for a, b, label in zip(ends, ends[1:], labels):
            leader.learn(slots.flat[a:b], values.flat[a:b].astype(np.float64), label)
    return leader.weights_at(np.arange(1 << bits))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, bits: int = BITS) -> np.ndarray:
    """Weights from about `sample` labelled ids, chosen and ordered by a hash of doc_id.

    They are dealt to a fixed number of shards; each goes through its own leader PASSES times, in the
    order of the hash, and the models are averaged. The driver gets `shards` arrays of 2**bits floats.
    Held-out ids, null labels, null ids and ids with both labels take no part; of several rows of an
    id the least text does. No rows give zero weights. Texts are whole, however long: a task holds those of
    its shard, at most about `sample` / `shards` texts.
    """
    spark = docs.sparkSession
    text_batches(spark)
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    usable = usable.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other")).filter("quality = other").drop("other")
    count = usable.count()
    order = F.xxhash64("doc_id", F.lit(7))
    chance = F.pmod(order, F.lit(1 << 40)) / float(1 << 40)
    chosen = usable.filter(chance < sample / max(count, 1))
    # about `sample` rows of two numbers, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # shard names that fall into different partitions
    names = spark.range(100 * shards).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    named = F.element_at(F.array(*(F.lit(r["id"]) for r in names)), F.pmod(order, F.lit(len(names))).cast("int") + 1)
    rows = rows.select("text", "quality", order.alias("h"), named.alias("shard"))

    def run(batches):
        import pandas as pd

        held = list(batches)
        out = [(shard, len(own), train(own["text"], own["quality"].tolist(), bits).astype("<f4").tobytes()) for shard, own in (pd.concat(held).groupby("shard", sort=True) if held else ())]
        yield pd.DataFrame(out, columns=["shard", "n", "weights"])
        del held
        given_back()

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h")
    models = dealt.mapInPandas(run, "shard long, n long, weights binary").collect()
    total = sum(r["n"] for r in models)
    return sum((np.frombuffer(r["weights"], "<f4") * (r["n"] / total) for r in sorted(models, key=lambda r: r["shard"])), np.zeros(1 << bits))


def score_documents(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """All columns of docs, and score and predicted, by one pass over the whole texts; no shuffle.

    Null and empty texts score by the bias alone; very long ones are read whole, a task holding one Arrow
    batch of texts. Columns of docs named score or predicted are replaced.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def of(text):
        import pandas as pd

        w = shared.value
        return pd.Series([score(x, w) for x in text])

    return docs.withColumn("score", of(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, weights).select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "score", "predicted")
