"""Sharding by best-fit-decreasing bin packing.

Equal texts form a group that is never divided. Groups, largest first, enter the bin with the least
remaining capacity that still holds them, found in a balanced tree ordered by remaining capacity;
the capacity is the smallest with which the wanted number of bins suffices. Groups are placed in runs:
the tightest bin takes groups, of whatever sizes, until one no longer fits or sizes fall to the room of a
tighter bin. Both ends are found by binary search in running sums, and a bin that is met again has at
most half its room, so a packing takes some bins * log2(largest size) steps, however many sizes there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.common import numbered, written

#: Groups with at least this share of all rows, so at most as many groups, are looked up by broadcast.
HOT = 10_000


class Tree:
    """A treap of (remaining, bin); priorities are a fixed mix of the key, so shapes repeat."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Trees of the keys below key and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Tree._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = Tree._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], Tree._merge(a[3], b))
        return (b[0], b[1], Tree._merge(a, b[2]), b[3])

    def add(self, key: tuple[int, int]) -> None:
        mixed = ((key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) >> 7) & 0xFFFFFFFF
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, (key, mixed, None, None)), b)

    def take_least(self, size: int) -> tuple[int, int] | None:
        """Remove and return the key with the least remaining capacity of size or more."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


    def most_below(self, size: int) -> int:
        """The most remaining capacity below size; 0 if there is none."""
        node, most = self.root, 0
        while node is not None:
            if node[0][0] < size:
                most, node = node[0][0], node[3]
            else:
                node = node[2]
        return most


Run = tuple[int, int]  # bin, groups


def runs_of(sizes: np.ndarray, many: np.ndarray, capacity: int, most_bins: int | None = None) -> list[Run] | None:
    """Best fit of all groups, largest first: which bin takes how many of them next.

    sizes: different sizes, descending; many: the groups of each. None if more than most_bins bins are needed.
    """
    groups, total, falling = np.cumsum(many), np.cumsum(sizes * many), -sizes
    tree, bins, out = Tree(), 0, []
    k = placed = used = 0  # the size at hand; groups and bytes placed
    while k < len(sizes):
        size = int(sizes[k])
        found = tree.take_least(size)
        if found is None:
            if bins == most_bins or size > capacity:
                return None
            found, bins = (capacity, bins), bins + 1
        room, own = found
        tighter = int(np.searchsorted(falling, -tree.most_below(size), "left"))  # first size for which another bin is tighter
        full = int(np.searchsorted(total, used + room, "right"))  # first size of which not all fit
        if tighter <= full:
            k, after, spent = tighter, int(groups[tighter - 1]), int(total[tighter - 1])
        else:
            start, spent = (placed, used) if full == k else (int(groups[full - 1]), int(total[full - 1]))
            fit = (used + room - spent) // int(sizes[full])
            k, after, spent = full, start + fit, spent + fit * int(sizes[full])
        out.append((own, after - placed))
        tree.add((room - (spent - used), own))
        placed, used = after, spent
    return out


def by_size(many, runs: list[Run]) -> list[list[Run]]:
    """Runs over all groups, cut at the ends of sizes."""
    out, left = [], list(reversed(runs))
    for n in many:
        own = []
        while n:
            b, took = left.pop()
            if took > n:
                left.append((b, took - n))
                took = n
            own.append((b, took))
            n -= took
        out.append(own)
    return out


def best_fit(classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[list[Run]] | None:
    """For each (size, groups) the bins that take them in turn; sizes must be descending.

    None if more than most_bins bins are needed.
    """
    many = [n for _, n in classes]
    runs = runs_of(np.array([s for s, _ in classes], np.int64), np.array(many, np.int64), capacity, most_bins)
    return None if runs is None else by_size(many, runs)


def runs_into(sizes: np.ndarray, many: np.ndarray, bins: int) -> list[Run]:
    """runs_of with the smallest capacity (to a part in 100,000) that fills no more than so many bins.

    A group beyond the mean of the bins still open gets a bin of its own, so that the others stay equal.
    """
    many, total, alone, k = many.copy(), int((sizes * many).sum()), 0, 0
    while k < len(sizes) and alone < bins - 1 and int(sizes[k]) * (bins - alone) > total:
        alone, total = alone + 1, total - int(sizes[k])
        many[k] -= 1
        k += not many[k]
    sizes, many, left = sizes[k:], many[k:], bins - alone
    largest = int(sizes[0]) if len(sizes) else 0
    low = max(-(-total // left), largest)
    high = low + (largest or 1)
    while (best := runs_of(sizes, many, high, left)) is None:
        low, high = high + 1, high * 2
    while high - low > low // 100_000:
        mid = (low + high) // 2
        got = runs_of(sizes, many, mid, left)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return [(b, 1) for b in range(alone)] + [(b + alone, n) for b, n in best]


def into_bins(classes: list[tuple[int, int]], bins: int) -> list[list[Run]]:
    """runs_into for (size, groups) pairs of descending sizes: for each the bins that take them in turn."""
    many = [n for _, n in classes]
    return by_size(many, runs_into(np.array([s for s, _ in classes], np.int64), np.array(many, np.int64), bins))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are nearly equal, with a gapless slot.

    Groups of equal texts are never divided. The driver packs two arrays, the distinct sizes of groups
    and how many groups have each: their number grows with the variety of sizes (at most the square root
    of twice all bytes, 230 MB of them at 100 TB), not with the documents, and the steps of packing with
    neither. Groups are numbered by size, and a group's number tells its shard. A group of more bytes than the mean shard has a shard of its own; then that shard
    is larger than the others, which is the one case in which their bytes are not nearly equal.

    Null text has no bytes and counts as equal to the empty text; a null doc_id is kept; repeated rows
    are placed each, in the shard of their text; an empty table gives none. Other columns, whatever
    their names, are not read. Rows of at most 48 bytes are shuffled, never texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group")), "shard-sizes")
    groups = written(slim.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("many"), F.sum("n").alias("n")).toPandas().sort_values("bytes", ascending=False)
    rows = int(sizes["n"].sum())
    # groups in order of size, numbered; the places from which on a shard takes them
    runs = runs_into(sizes["bytes"].to_numpy(np.int64), sizes["many"].to_numpy(np.int64), shards)[::-1] if rows else []
    starts = np.cumsum([0, *(n for _, n in runs)])[:-1]
    shared = spark.sparkContext.broadcast((starts, np.array([b for b, _ in runs], np.int32)))

    @F.pandas_udf("int")
    def shard_of(idx):
        import pandas as pd

        at, to = shared.value
        return pd.Series(to[np.searchsorted(at, idx.to_numpy(), side="right") - 1] if len(idx) else np.zeros(0, np.int32))

    placed = written(numbered(groups, "bytes", "group").select("group", "n", shard_of("idx").alias("shard")), "shard-places")
    # a group of many rows is looked up by broadcast, so its rows need not meet
    hot = F.broadcast(placed.filter(F.col("n") >= max(2, rows // HOT)).select("group", "shard"))
    cold = placed.filter(F.col("n") < max(2, rows // HOT)).select("group", F.col("shard").alias("_s"))
    first = slim.join(hot, "group", "left")
    known = first.filter("shard is not null")
    rest = first.filter("shard is null").drop("shard").join(cold, "group").withColumnRenamed("_s", "shard")
    at = written(known.unionByName(rest).drop("group"), "shard-rows")
    before, total = {}, 0
    for r in sorted(at.groupBy("shard").agg(F.count("*").alias("n")).collect()):
        before[r["shard"]], total = total, total + r["n"]
    if not before:
        return at.withColumn("slot", F.lit(0).cast("long"))
    # equal rows are told apart by where they are stored, so they spread over tasks too
    told = numbered(at.withColumn("_at", F.monotonically_increasing_id()), "shard", "doc_id", "text_crc32", "_at")
    offset = F.element_at(F.array(*(F.lit(before.get(k, 0)).cast("long") for k in range(shards))), F.col("shard") + 1)
    return told.withColumn("slot", F.col("idx") - offset).drop("idx", "_at")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
