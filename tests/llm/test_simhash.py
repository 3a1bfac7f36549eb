"""SimHash near copies against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridjobs.llm import simhash
from tests.llm.test_operators import DOCS, HARD

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(rows):
    """Wanted rows of (doc_id, text)."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted((str(k), f"{f:016x}", str(least.get(top(i)))) for i, ((k, _), f) in enumerate(zip(rows, fps)))


def told(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert told(simhash.op11_simhash(spark, DATA)) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_hard_cases(spark):
    hard = spark.createDataFrame(HARD, DOCS).withColumns({c: F.lit(1) for c in ("fp", "no_id", "part", "value", "own", "asks", "root", "node", "component_id")})
    assert told(simhash.near_duplicates(hard)) == brute([(r[0], r[1]) for r in HARD])
    assert told(simhash.near_duplicates(spark.createDataFrame([], DOCS))) == []
    nulls = spark.createDataFrame([(None, None), (None, ""), (None, "a b")], "doc_id long, text string")
    assert told(simhash.near_duplicates(nulls)) == brute([(None, None), (None, ""), (None, "a b")])


def test_very_long_text_through_spark(spark):
    words = [f"w{random.Random(1).randrange(9)}{i % 977}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, "short")]
    assert told(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def clustered(rng, n):
    """Far points, chains of points a few bits apart, and a dense group; a third of the bits hardly vary."""
    far = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64(0x5555FFFFFFFF0F0F)
    out = list(far)
    for x in far[: n // 4]:
        for _ in range(6):
            x ^= np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
            out.append(x)
    out += [far[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False))) for _ in range(n)]
    return np.unique(np.array(out, np.uint64))


def wanted_components(fp, most):
    left, out = set(range(len(fp))), {}
    while left:
        front = [min(left, key=lambda i: int(fp[i]))]
        name = front[0]
        left -= set(front)
        while front:
            i = front.pop()
            out[int(fp[i])] = name
            hit = [j for j in left if int(fp[i] ^ fp[j]).bit_count() <= most]
            left -= set(hit)
            front += hit
    return out


@pytest.mark.parametrize("tile, few, most", [(1 << 17, 8, 4), (5, 2, 4), (40, 8, 2), (1 << 17, 8, 1)])
def test_links_of_points(spark, monkeypatch, tile, few, most):
    """Every plan, tiles forced small: the links connect what brute force connects, and nothing else."""
    monkeypatch.setattr(simhash, "TILE", tile)
    fp = clustered(np.random.default_rng(most + tile), 60)
    points = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    want = wanted_components(fp, most)
    for plan in simhash.plans_of(points, len(fp), most):
        t, cost = plan.thresholds(fp)
        assert (t.sum(0) == most - len(plan.parts) + 1).all() and (t >= -1).all() and np.isfinite(cost).all()
        looks = simhash.on_points(points, plan.looks, "part int, value long, fp long, own boolean, asks boolean")
        links = simhash.linked(looks, most).collect()
        pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]
        assert all(0 < (a ^ b).bit_count() <= most for a, b in pairs)
        root = {int(x): int(x) for x in fp}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[top(a)] = top(b)
        assert len({top(x) for x in root}) == len(set(want.values()))
        assert all(want[a] == want[top(a)] for a in root)


def test_thresholds_are_the_least_cost():
    rng = np.random.default_rng(3)
    fp = clustered(rng, 50)
    parts = simhash.layout(np.zeros((64, 64)), 4)
    counts = [[np.bincount(simhash.value_of(fp, b).astype(int), minlength=1 << len(b)) for b in simhash.blocks_of(p)] for p in parts]
    plan = simhash.Plan(parts, counts, len(fp), 4)
    costs = plan.costs(fp)
    for i in range(4):  # exact counts in partitions of one block
        v = simhash.value_of(fp, parts[i])
        for t in range(3):
            n = sum(int(v[0] ^ x).bit_count() <= t for x in v)
            assert costs[i, t + 1, 0] == n + simhash.LOOK * sum(len(list(simhash.combinations(range(16), r))) for r in range(t + 1))
    _, best = plan.thresholds(fp)
    for k in range(0, len(fp), 17):
        least = min(sum(costs[i, t, k] for i, t in enumerate(ts)) for ts in np.ndindex(6, 6, 6, 6) if sum(ts) == 5)
        assert np.isclose(best[k], least)


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    fp = np.array([sum(1 << b for b in range(64) if rng.random() < 0.5) for _ in range(400)], np.uint64)
    for b in (3, 20, 41, 60):  # copies of bit 10
        fp = (fp & ~np.uint64(1 << b)) | (((fp >> np.uint64(10)) & np.uint64(1)) << np.uint64(b))
    bits = simhash.bit_columns(fp).astype(float)
    parts = simhash.layout(np.nan_to_num(np.abs(np.corrcoef(bits.T)) - np.eye(64)), 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, 10, 20, 41, 60} <= set(p) for p in parts)


def test_shingle_hash_is_the_engines(spark):
    text = "Some Words of a text, é and 日本"
    got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"] % (1 << 64)
    assert got == xxhash.xxh64_intdigest(text.encode(), 42)
