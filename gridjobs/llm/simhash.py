"""Near duplicates by 64-bit SimHash and the generalised pigeonhole principle, as connected components.

The bits of a fingerprint are dealt to m partitions, correlated bits together. If the thresholds t of a
fingerprint's partitions sum to most - m + 1 (a threshold may be -1: not asked), every fingerprint within
`most` bits differs by at most t in some partition. Each fingerprint gets its own unequal thresholds by
dynamic programming on estimated candidate counts, looks into all buckets (partition, value) within them,
and meets the fingerprints stored there. Buckets give a spanning forest of their verified links, never all
pairs; large ones are dealt to tiles of bounded size.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.llm.common import dropped, ids_and_texts, text_batches, written
from gridjobs.llm.jaccard import components
from gridjobs.llm.tokens import groups_of, utf8

WORDS, SEED, MOST = 4, 42, 4
BITS = 64
#: Numbers of partitions to choose from, most bits of a counted block of a partition.
PARTITIONS = (2, 3, 4, 5)
BLOCK_BITS = 16
#: Cost of one look into a bucket, against that of one comparison.
LOOK = 500.0
#: Fingerprints of either side that meet in one task.
TILE = 1 << 17
#: Shingles that are hashed at once.
SLICE = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit k is 1 if over half of the shingles' XXH64 have it; no words: 0."""
    from xxhash import xxh64_intdigest as h64

    parts = utf8(text or "").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return h64(whole, SEED)
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(lens) - lens
    ends = (starts + lens - 1)[words - 1 :]
    starts = starts[: len(ends)]
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(ends), SLICE):
        hashes = np.array([h64(whole[a:b], SEED) for a, b in zip(starts[i : i + SLICE].tolist(), ends[i : i + SLICE].tolist())], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, no_id, fp) of every row; fp as a signed long."""
    docs = ids_and_texts(docs)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for a, b in groups_of(batch["text"]):
                some = batch.iloc[a:b]
                fps = np.array([fingerprint(t, words) for t in some["text"]], np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "no_id": some["no_id"].to_numpy(), "fp": fps})

    return docs.mapInPandas(run, "doc_id long, no_id boolean, fp long")


def on_points(points: DataFrame, made, schema: str) -> DataFrame:
    """Rows that made gives for each batch of fingerprints (as uint64)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield from made(batch["fp"].to_numpy().astype(np.int64).view(np.uint64))

    return points.select("fp").mapInPandas(run, schema)


def bit_columns(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(points: DataFrame, n: int) -> np.ndarray:
    """Absolute correlation of every two bits over all fingerprints; 0 beside a constant bit."""

    def made(fp):
        import pandas as pd

        b = bit_columns(fp).astype(np.float64)
        yield pd.DataFrame({"at": range(BITS * BITS), "n": (b.T @ b).ravel()})

    both = np.zeros(BITS * BITS)
    for r in on_points(points, made, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4,096 rows
        both[r["at"]] = r["n"] / max(n, 1)
    both = both.reshape(BITS, BITS)
    mean = both.diagonal()
    spread = np.sqrt(mean * (1 - mean))
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(found, 0)
    return np.nan_to_num(found, nan=0.0, posinf=0.0)


def layout(correlated: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the bit that correlates most with its bits."""
    left, out = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        part = [max(left, key=lambda b: (correlated[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (correlated[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(part)
    return out


def blocks_of(part: list[int]) -> list[list[int]]:
    """A partition's bits in blocks whose values can all be counted."""
    k = -(-len(part) // BLOCK_BITS)
    size = -(-len(part) // k)
    return [part[i : i + size] for i in range(0, len(part), size)]


def value_of(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def block_counts(points: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each block: at most 2^16 numbers a block, over all rows."""

    def run(batches):
        import pandas as pd

        counts = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            fp = batch["fp"].to_numpy().astype(np.int64).view(np.uint64)
            for c, b in zip(counts, blocks):
                c += np.bincount(value_of(fp, b).astype(np.int64), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pd.DataFrame({"block": np.full(len(at), k), "value": at, "n": c[at]})

    def whole(batch):
        import pandas as pd

        k = int(batch["block"].iloc[0])
        counts = np.zeros(1 << len(blocks[k]), np.int64)
        counts[batch["value"].to_numpy()] = batch["n"].to_numpy()
        return pd.DataFrame({"block": [k], "counts": [counts.tobytes()]})

    parts = points.select("fp").mapInPandas(run, "block int, value int, n long").groupBy("block", "value").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << len(b), np.int64) for b in blocks]
    for r in parts.groupBy("block").applyInPandas(whole, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out


def at_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """[r, v]: how many fingerprints have a block value r bits from v, r up to most."""
    near = np.zeros((most + 1, len(counts)), np.float32)
    near[0] = counts
    values = np.arange(len(counts))
    for k in range(len(counts).bit_length() - 1):
        turned = near[:, values ^ (1 << k)]
        near[1:] += turned[:-1]
    return near


class Plan:
    """Partitions of the bits and what is known of their values."""

    def __init__(self, parts: list[list[int]], counts: list[list[np.ndarray]], n: int, most: int):
        self.parts, self.n, self.most = parts, max(n, 1), most
        self.blocks = [blocks_of(p) for p in parts]
        self.near = [[at_distance(c, most) for c in own] for own in counts]

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """[partition, t + 1, row]: estimated cost of asking a partition within t bits; 0 if not asked.

        Candidates are counted exactly in partitions of one block; blocks of a wider one are taken as
        independent.
        """
        out = np.zeros((len(self.parts), self.most + 2, len(fp)))
        for i, part in enumerate(self.parts):
            exact = None
            for block, near in zip(self.blocks[i], self.near[i]):
                own = near[:, value_of(fp, block).astype(np.int64)].astype(np.float64)
                if exact is None:
                    exact = own
                else:
                    exact = np.stack([sum(exact[a] * own[r - a] for a in range(r + 1)) / self.n for r in range(self.most + 1)])
            looks = np.cumsum([comb(len(part), r) for r in range(self.most + 1)]) * LOOK
            out[i, 1:] = np.cumsum(exact, 0) + looks[:, None]
        return out

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[partition, row] thresholds from -1 that sum to most - m + 1 at the least cost, and that cost."""
        costs, total = self.costs(fp), self.most + 1
        best = np.full((total + 1, len(fp)), np.inf)
        best[0] = 0
        took = np.zeros((len(self.parts), total + 1, len(fp)), np.int8)
        for i, cost in enumerate(costs):
            new = np.full_like(best, np.inf)
            for s in range(total + 1):
                for t in range(s + 1):
                    c = best[s - t] + cost[t]
                    better = c < new[s]
                    new[s][better] = c[better]
                    took[i, s][better] = t
            best = new
        out, s, rows = np.zeros((len(self.parts), len(fp)), np.int64), np.full(len(fp), total), np.arange(len(fp))
        for i in range(len(self.parts) - 1, -1, -1):
            out[i] = took[i, s, rows]
            s = s - out[i]
        return out - 1, best[total]

    def looks(self, fp: np.ndarray):
        """(part, value, fp, own, asks): every fingerprint is stored in its own bucket of every partition and
        looks into those within its thresholds."""
        import pandas as pd

        def rows(i, value, fp, own, asks):
            return pd.DataFrame({"part": np.full(len(fp), i), "value": value.view(np.int64), "fp": fp.view(np.int64), "own": own, "asks": asks})

        t, _ = self.thresholds(fp)
        for i, part in enumerate(self.parts):
            value = value_of(fp, part)
            yield rows(i, value, fp, np.full(len(fp), True), t[i] >= 0)
            for most in range(1, self.most + 1):
                at = np.flatnonzero(t[i] == most)
                masks = np.array([sum(1 << b for b in c) for r in range(1, most + 1) for c in combinations(range(len(part)), r)], np.uint64)
                step = max(1, (1 << 19) // max(len(masks), 1))
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    seen = (value[some][:, None] ^ masks).ravel()
                    yield rows(i, seen, np.repeat(fp[some], len(masks)), np.full(len(seen), False), np.full(len(seen), True))


def plans_of(points: DataFrame, n: int, most: int) -> list[Plan]:
    """A plan for each number of partitions."""
    correlated = correlations(points, n)
    layouts = [layout(correlated, m) for m in PARTITIONS if m <= most + 1]
    blocks = [b for parts in layouts for p in parts for b in blocks_of(p)]
    counts = iter(block_counts(points, blocks))
    return [Plan(parts, [[next(counts) for _ in blocks_of(p)] for p in parts], n, most) for parts in layouts]


def cheapest(points: DataFrame, plans: list[Plan]) -> Plan:
    """The plan with the least estimated cost over all fingerprints."""
    shared = points.sparkSession.sparkContext.broadcast(plans)

    def made(fp):
        import pandas as pd

        yield pd.DataFrame({"plan": range(len(shared.value)), "cost": [float(p.thresholds(fp)[1].sum()) for p in shared.value]})

    costs = {r["plan"]: r["cost"] for r in on_points(points, made, "plan int, cost double").groupBy("plan").agg(F.sum("cost").alias("cost")).collect()}
    return plans[min(costs, key=lambda k: (costs[k], k), default=0)]


def forest(fp: np.ndarray, own: np.ndarray, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (by place) that connect what the links of an asking and a stored fingerprint connect.

    A component is taken out as it is found, so a dense group costs few comparisons; those without a link
    go by blocks.
    """
    links: list[tuple[np.ndarray, np.ndarray]] = []
    rest = np.argsort(~asks, kind="stable")

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        found = np.bitwise_count(fp[some][:, None] ^ fp[others]) <= most
        return found & ((asks[some][:, None] & own[others]) | (own[some][:, None] & asks[others]))

    while len(rest) and asks[rest[0]]:
        seeds = rest[: max(1, min(64, (1 << 20) // len(rest)))]
        seeds = seeds[asks[seeds]]
        found = near(seeds, rest)
        found[np.arange(len(seeds)), np.arange(len(seeds))] = False
        linked = seeds[found.any(1)]
        if not len(linked):
            rest = rest[len(seeds) :]
            continue
        front, rest = linked[:1], rest[rest != linked[0]]
        while len(front) and len(rest):
            head, front = np.split(front, [max(1, min(64, (1 << 20) // len(rest)))])
            found = near(head, rest)
            hit = found.any(0)
            links.append((head[found[:, hit].argmax(0)], rest[hit]))
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


#: Buckets of so few rows are compared side by side over a whole batch.
FEW = 8


def bucket_links(keys: np.ndarray, fp: np.ndarray, own: np.ndarray, asks: np.ndarray, most: int) -> np.ndarray:
    """(k, 2) linked fingerprints of whole buckets, keys telling where one ends."""
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edge, len(keys)))
    out = []
    small = np.repeat(sizes <= FEW, sizes)
    for d in range(1, min(FEW, len(keys))):
        fits = small[d:] & (keys[d:] == keys[:-d]) & ((asks[d:] & own[:-d]) | (own[d:] & asks[:-d]))
        fits &= np.bitwise_count(fp[d:] ^ fp[:-d]) <= most
        out.append(np.stack([fp[:-d][fits], fp[d:][fits]], 1))
    for a, size in zip(edge[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        b = slice(a, a + size)
        if own[b].any() and asks[b].any():
            x, y = forest(fp[b], own[b], asks[b], most)
            out.append(np.stack([fp[b][x], fp[b][y]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def linked(looks: DataFrame, most: int) -> DataFrame:
    """(a, b): links that connect all that is within `most` bits, from looks (part, value, fp, own, asks)."""
    sizes = looks.groupBy("part", "value").agg(F.count_if("own").alias("o"), F.count_if("asks").alias("q")).filter((F.col("o") > TILE) | (F.col("q") > TILE))
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    large = written(sizes.select("part", "value", tiles("o").alias("os"), tiles("q").alias("qs")), "simhash-large")
    side = F.xxhash64("fp")
    dealt = looks.join(large, ["part", "value"], "left").withColumn("os", F.greatest(F.coalesce("os", F.lit(1)), F.lit(1))).withColumn("qs", F.greatest(F.coalesce("qs", F.lit(1)), F.lit(1)))
    # one row for every tile of its stored and asking place
    dealt = dealt.withColumn("o", F.pmod(side, F.col("os")).cast("int")).withColumn("q", F.pmod(side, F.col("qs")).cast("int"))
    stored = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.struct(F.col("o").alias("o"), q.alias("q"))))
    asking = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda o: F.struct(o.alias("o"), F.col("q").alias("q"))))
    none = F.array().cast("array<struct<o:int,q:int>>")
    tile = F.explode(F.array_distinct(F.concat(F.coalesce(stored, none), F.coalesce(asking, none))))
    dealt = dealt.select("part", "value", "fp", (F.col("own")).alias("own"), "asks", F.col("o").alias("oo"), F.col("q").alias("qq"), tile.alias("t"))
    dealt = dealt.select("part", "value", F.col("t.o").alias("o"), F.col("t.q").alias("q"), "fp", (F.col("own") & (F.col("t.o") == F.col("oo"))).alias("own"), (F.col("asks") & (F.col("t.q") == F.col("qq"))).alias("asks"))
    keys = ["part", "value", "o", "q"]

    def run(batches):
        import pandas as pd

        held = None
        def done(rows):
            same = np.zeros(len(rows), np.int64)
            for k in keys:
                x = rows[k].to_numpy()
                same[1:] |= x[1:] != x[:-1]
            found = bucket_links(np.cumsum(same), rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy(), rows["asks"].to_numpy(), most)
            found = np.unique(found, axis=0).view(np.int64)
            return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1]
            open_ = np.logical_and.reduce([batch[k].to_numpy() == last[k] for k in keys])
            held = held or []
            if open_.all() and (not held or all(held[-1][k].iloc[-1] == last[k] for k in keys)):
                held.append(batch)
                continue
            yield done(pd.concat([*held, batch[~open_]], ignore_index=True))
            held = [batch[open_]]
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach; fingerprints link at `most` or fewer differing
    bits. Null text counts as empty; texts without words have fingerprint 0, which links like any other. A
    null doc_id takes part and never is the smallest; repeated rows each get their row; an empty table gives
    none. Rows of one fingerprint meet as one point, so copies cost no pairs. Columns of other names are
    not read. A task holds one Arrow batch of texts and the hashes of 32,768 shingles, however long a text
    is; after the first pass no task holds a text.
    """
    text_batches(docs.sparkSession)
    first = written(fingerprints(docs, words), "simhash-first").withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    points = written(first.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-points")
    n = points.count()
    plan = cheapest(points, plans_of(points, n, most))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    looks = written(on_points(points, lambda fp: shared.value.looks(fp), "part int, value long, fp long, own boolean, asks boolean"), "simhash-looks")
    links = written(linked(looks, most), "simhash-links")
    dropped(looks)
    roots = components(links)
    placed = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return first.join(named, "fp").select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
